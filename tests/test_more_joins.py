"""Overlapping segments, sketches, the table function, sections with gaps and text ids."""

import random

from pyspark.sql import functions as F

from seriesmith.functions import tables
from seriesmith.operators import joins, sections, series, sketches


def test_frames_in_nested_segments_against_brute_force(spark):
    rng = random.Random(1)
    segments = [("a", k, s, s + rng.choice([0, 1, 3, 8, 100, -2])) for k in range(60) for s in [rng.randrange(-50, 400)]]
    segments += [("a", 1000, -1000, 1000), ("b", 1, 5, 5), ("c", 1, 0, 10)]
    frames = [(r, f, "x") for r in "abd" for f in range(-60, 420, 3)] + [("a", 10, "again"), ("a", 10, "again")]
    seg = spark.createDataFrame(segments, "run_id string, seg int, start int, end int")
    frm = spark.createDataFrame(frames, "run_id string, frame int, note string")
    want = [(r, f, n, s[1]) for r, f, n in frames for s in segments if s[0] == r and s[2] <= f <= s[3]]
    key = lambda r: (*r[:3], -1 if r[3] is None else r[3])
    assert sorted((tuple(r) for r in joins.containing_segments(frm, seg).collect()), key=key) == sorted(want, key=key)
    found = {x[:2] for x in want}
    left = want + [(r, f, n, None) for r, f, n in frames if (r, f) not in found]
    assert sorted((tuple(r) for r in joins.containing_segments(frm, seg, "left").collect()), key=key) == sorted(left, key=key)
    plan = joins.containing_segments(frm, seg)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_long_segment_does_not_spread_frames(spark):
    """A frame looks into a bin a width, however long the longest segment is."""
    seg = spark.range(2000).select(F.lit(1).alias("run_id"), F.col("id").alias("seg"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    seg = seg.unionByName(spark.createDataFrame([(1, -1, 0, 1 << 40)], "run_id int, seg long, start long, end long"))
    frm = spark.range(20000).select(F.lit(1).alias("run_id"), F.col("id").alias("frame"))
    assert joins.containing_segments(frm, seg).groupBy("frame").count().where("count <> 2").count() == 0


def test_sketches_merge_to_what_one_sketch_sees(spark, monkeypatch):
    monkeypatch.setattr(sketches, "FAN", 4)
    df = spark.range(30_000).select((F.col("id") % 150).alias("run_id"), ((F.col("id") * 7919) % 10_007).cast("int").alias("raw")).unionByName(spark.createDataFrame([(999, None)], "run_id long, raw int"))
    runs = sketches.sketch(df, ["run_id"], "raw")
    assert runs.count() == 151
    total = sketches.merge(runs, [])
    row = total.select("n", *[sketches.quantile("quantiles", q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.9))], sketches.different("distinct").alias("d")).collect()
    assert len(row) == 1 and row[0]["n"] == 30_000
    for k, q in enumerate((0.1, 0.5, 0.9)):
        rank = df.where(F.col("raw") <= row[0][f"q{k}"]).count() / 30_000
        assert abs(rank - q) <= sketches.RANK_ERROR
    assert abs(row[0]["d"] - 10_007) <= sketches.DISTINCT_ERROR * 10_007
    by = sketches.merge(runs.withColumn("odd", F.col("run_id") % 2), ["odd"])
    assert {r["odd"]: r["n"] for r in by.collect()} == {0: 15_000, 1: 15_000}


def gaps(spark, kind):
    rows = [("r1" if kind == "string" else 1, seg, mid, 2, raw) for seg, mid, raw in [(0, 0, 10), (2, 30, 12), (4, 60, 14), (6, 90, 60), (8, 120, 62), (9, 150, None), (12, 180, 62), (15, 210, 63)]]
    return spark.createDataFrame(rows, f"run_id {kind}, seg int, mid int, len int, raw int")


def test_sections_start_at_rows_that_exist(spark):
    for kind, run in (("long", 1), ("string", "r1")):
        df = gaps(spark, kind)
        found = sections.sections(df, 5.0)
        assert sorted(tuple(r) for r in found.collect()) == [(run, 0, 4), (run, 4, 6), (run, 6, 8), (run, 12, 15)]
        assert sections.trusted_sections(df, found, 4).count() > 0


def test_table_function_gives_the_same_sections(spark):
    tables.register(spark)
    for kind in ("long", "string"):
        df = gaps(spark, kind)
        steps = series.pair_accelerations(df, 30.0).select("run_id", "seg", F.col("accel").cast("double").alias("accel"))
        got = spark.sql("SELECT * FROM steady_sections(TABLE({steps}), 5.0D)", steps=steps)
        assert got.dtypes == sections.sections(df, 5.0).dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sections.sections(df, 5.0).collect()))
