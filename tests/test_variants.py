"""Odd rows of the other forms of detection and scoring, against values worked out by hand."""

import math
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from seriesmith.operators import pixels, series, variants

SCHEMA = "run_id int, seg int, mid int, len int, raw int, truth int"


def rows_of(spark, values, step=10):
    return spark.createDataFrame([(1, k, k * step, 1, v, v) for k, v in enumerate(values)], SCHEMA)


def test_pairs_expect_what_lies_on_their_lines(spark):
    df = variants.pair_expectation(series.local_bandwidth(rows_of(spark, [10, 12, 14, 90, 18, 20, 22, None])))
    got = {r["seg"]: r for r in variants.detect_pairs(df).collect()}
    v = {0: 10, 1: 12, 2: 14, 3: 90, 4: 18, 5: 20, 6: 22}
    for k in range(8):
        pairs = [v[a] + (v[b] - v[a]) * (k - a) / (b - a) for a in v for b in v if a < k < b]
        assert got[k]["expected"] is None if not pairs else math.isclose(got[k]["expected"], median(pairs))
    # the ends have no pair; the neighbours of a jump are suspect only where jumps count
    assert [k for k in got if got[k]["suspect"]] == [0, 3, 6, 7]
    assert sorted(r["seg"] for r in variants.detect_pairs(df, jump_floor=2.0).where("suspect").collect()) == [0, 2, 3, 4, 6, 7]


def test_pairs_at_one_time_are_left_out(spark):
    df = spark.createDataFrame([(1, k, 7, 1, v, v) for k, v in enumerate([1, 2, 3])], SCHEMA)
    assert {r["expected"] for r in variants.pair_expectation(df).collect()} == {None}


def test_residual_score_of_odd_values(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([5.0, 5.0, -1.0, 5.0, 9.0])], "run_id int, seg int, value double")
    got = [r["score"] for r in variants.residual_score(df, half=1).orderBy("seg").collect()]
    assert got[2] == 0.0 and got[0] == 100.0
    nan = spark.createDataFrame([(1, 0, float("nan")), (2, 0, None)], "run_id int, seg int, value double")
    assert [r["score"] for r in variants.residual_score(nan, half=1).orderBy("run_id").collect()] == [50.0, 50.0]


def test_rates_without_rows_to_share_are_null(spark):
    df = spark.createDataFrame([(1, 5, 5, float("nan")), (1, None, 5, None), (2, 9, 5, 90.0)], "run_id int, raw int, truth int, conf double")
    got = {r["run_id"]: r for r in variants.detection_rates(df).collect()}
    assert got[1]["detected"] is None and got[1]["false_alarms"] == 100.0 and got[1]["flagged"] == 100.0
    assert got[2]["false_alarms"] is None and got[2]["detected"] == 0.0
    assert got[None]["rows"] == 3


def test_gain_of_a_region(spark):
    df = rows_of(spark, [3, None, 8, 11, 20])
    assert variants.region_gain(df, "seg", "raw", 1, 3).collect()[0]["gain"] == 3
    assert variants.region_gain(df, "seg", "raw", 9, 12).collect()[0]["gain"] is None


def test_empty_tables(spark):
    df = series.local_bandwidth(spark.createDataFrame([], SCHEMA))
    assert variants.detect_pairs(variants.pair_expectation(df)).count() == 0
    assert variants.ungated_confidence(df).count() == 0
    assert series.runs(df).count() == series.run_digests(df, F.lit("")).count() == 0
    assert variants.residual_score(df, "raw").count() == 0


def test_shares_of_masks(spark):
    a = np.zeros((4, 4), int)
    a[0, :3] = a[1, 3] = a[3, 0] = 1
    rows = [(1, a.ravel().tolist(), 4, "x"), (2, None, 4, "y"), (3, [0] * 16, 4, "z")]
    df = spark.createDataFrame(rows, "id int, mask array<int>, w int, biggest string")
    got = {r["id"]: (r["biggest"], r["clustered"]) for r in pixels.component_shares(df, "mask", "w").collect()}
    assert got == {1: (4, 0.8), 2: (None, None), 3: (0, 0.0)}


def test_sizes_of_inputs(spark):
    df = spark.createDataFrame([(96, 48), (96, 47), (1, 4800), (7, 0)], "w int, h int")
    got = [tuple(r) for r in df.select(pixels.input_width(F.col("w"), F.col("h")), pixels.keeps_size(F.col("w"), F.col("h")), pixels.keeps_size(F.col("w"), F.col("h"), aspect=2.0)).collect()]
    assert got == [(96, True, True), (98, False, False), (1, False, False), (7, False, False)]


def test_calibration_at_an_even_step(spark):
    rows = [(1, k, [k % 7] * 8 + [200 + k % 7] * 8) for k in range(130)]
    got = pixels.calibration(spark.createDataFrame(rows, "label int, vec_id int, px array<int>"), "label", "vec_id", spread=True).collect()
    assert got[0]["threshold"] == int(median(k % 7 for k in range(0, 100, 2)))
