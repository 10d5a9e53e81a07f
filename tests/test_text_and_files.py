"""Text functions, log files, sources, pictures and the stream."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import recognise, text
from seriesmith.operators import joins, pixels
from seriesmith.sources import logs, pictures
from seriesmith.streaming import segmenter


def one(spark, column, *value):
    return spark.range(1).select(column(*[F.lit(v) for v in value]).alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("O5B", "058"), ("12l", "121"), ("3,5", "3.5")])
def test_normalise(spark, given, want):
    assert one(spark, text.normalise_text, given) == want


@pytest.mark.parametrize("given, want", [("12O", 120), ("", None), (None, None), ("3,5", 35), ("abc", None), (" 1 2 0 ", 120)])
def test_extract(spark, given, want):
    assert one(spark, lambda c: text.extract_number(c.cast("string")), given) == want


@pytest.mark.parametrize("given, want", [("1, 2,3,4", [1, 2, 3, 4]), ("1,2,3", None), ("1,2,x,4", None), ("", None)])
def test_roi(spark, given, want):
    assert one(spark, text.to_roi, given) == want


@pytest.mark.parametrize("given, want", [("400.0", 400), ("abc", None), ("", None), (" 7 ", 7)])
def test_to_int(spark, given, want):
    assert one(spark, text.to_int, given) == want


@pytest.mark.parametrize("given, want", [("onnxruntime", "cpu"), ("tensorrt", "tensorrt"), ("tensorrt+onnxruntime", "auto"), (" Unknown ", None)])
def test_backend(spark, given, want):
    assert one(spark, text.backend_name, given) == want


@pytest.mark.parametrize("given, want", [(0.5, "0:00"), (61.0, "1:01"), (3661.0, "1:01:01"), (-3.0, "0:00"), (1.5, "0:02")])
def test_duration(spark, given, want):
    assert one(spark, text.duration, given) == want


def test_header_map_keeps_commas_and_the_last_value(spark):
    m = one(spark, text.header_map, "roi=1,2,3,4, a=x, b=, a=y")
    assert m == {"roi": "1,2,3,4", "a": "y", "b": ""}


def test_log_round_trip(spark, tmp_path):
    log = spark.createDataFrame([(7, 0, 0.0, 50, 21), (7, 1, 1.234, None, 12), (8, 0, 0.0, 5, 0)], "run_id long, frame int, dist double, speed int, flag int")
    head = spark.createDataFrame([(7, ["log v1", "video=a, fps=25.000", "roi=1,2,3,4, max_speed=x"]), (8, ["log v1", "video=b"])], "run_id long, header array<string>")
    path = str(tmp_path / "logs")
    logs.write_logs(log, head, path)
    raw = open(next(p for p in (tmp_path / "logs" / "run_id=7").iterdir() if p.name.startswith("part")), "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf# log v1\n# video=a, fps=25.000\n") and raw.endswith(b"0,0.00,50,21\n1,1.23,-1,12\n")
    lines = logs.read_lines(spark, f"{path}/*/*.txt")
    rows = [(r["frame"], r["dist"], r["speed"], r["flag"]) for r in logs.body_rows(lines).where("path like '%run_id=7%'").orderBy("line").collect()]
    assert rows == [(0.0, 0.0, 50.0, 21), (1.0, 1.23, -1.0, 12)]
    typed = logs.typed_settings(logs.headers(lines)).where("path like '%run_id=7%'").first()
    assert (typed["set_video"], typed["set_fps"], typed["set_roi"], typed["set_max_speed"]) == ("a", 25.0, [1, 2, 3, 4], None)
    curve = logs.read_curves(spark, f"{path}/*/*.txt").where("path like '%run_id=7%'").orderBy("idx").collect()
    assert [r["t"] for r in curve] == [0.0, 1 / 25]


def test_headers_stop_at_the_first_row_and_bad_rows_go(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿# fps=10\n1,2.0,3\nx,1,2\n5,6\n# fps=99\n2,3.0,4,11\n", encoding="utf-8")
    lines = logs.read_lines(spark, str(tmp_path / "a.csv"))
    assert logs.headers(lines).first()["settings"] == {"fps": "10"}
    assert [(r["frame"], r["flag"]) for r in logs.body_rows(lines).orderBy("line").collect()] == [(1.0, 0), (2.0, 11)]
    assert [(r["frame"], r["truth"]) for r in logs.read_truth(spark, str(tmp_path / "a.csv")).orderBy("frame").collect()] == [(1, 3.0), (2, 4.0)]


def test_named_columns_may_be_missing(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# about\nframe,raw_val\n1,2.5\n2,x\n")
    rows = logs.read_named(spark, str(tmp_path / "r.csv"), ["frame", "raw_val", "sig_abs"]).orderBy("frame").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.5, None), (2.0, None, None)]


def test_series_json_and_dictionary(spark, tmp_path):
    doc = {"video": "v", "version": "1", "tol": 1.0, "meta": {}, "segments": [{"rep": 1, "mid": 2, "len": 3, "raw": None, "corr": 5, "truth": 6}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    assert tuple(logs.read_series_json(spark, str(tmp_path / "s.json")).first()) == ("v", "1", 1.0, 0, 1, 2, 3, None, 5, 6)
    (tmp_path / "d.txt").write_text("a\nb\n")
    assert [tuple(r) for r in logs.read_dictionary(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()] == [(0, "blank"), (1, "a"), (2, "b"), (3, " ")]


def test_ctc(spark):
    chars = F.array(*[F.lit(c) for c in ("blank", "1", "2")])
    got = spark.range(1).select(text.ctc_decode(F.array(*map(F.lit, (1, 1, 0, 1, 2))), F.array(*map(F.lit, (0.5, 0.9, 0.9, 0.7, 0.9))), chars).alias("d")).first()["d"]
    assert (got["text"], got["score"]) == ("112", 0.7)
    empty = spark.range(1).select(text.ctc_decode(F.array(F.lit(0)), F.array(F.lit(0.9)), chars).alias("d")).first()["d"]
    assert (empty["text"], empty["score"]) == ("", 0.0)


def test_otsu_and_change(spark):
    rng = np.random.default_rng(0)
    px = np.clip(np.concatenate([rng.normal(40, 6, 300), rng.normal(200, 6, 300)]), 0, 255).astype(int).tolist()
    df = spark.createDataFrame([(1, px), (2, [9] * 10)], "k int, px array<int>")
    got = {r["k"]: r["threshold"] for r in pixels.otsu(df, ["k"]).collect()}
    assert 50 < got[1] < 180 and got[2] == 127
    masks = {"none": [0] * 64, "block": [int(2 <= k // 8 < 6 and 2 <= k % 8 < 6) for k in range(64)], "sparse": [int(k % 3 == 0 and (k // 8) % 3 == 0) for k in range(64)]}
    rows = spark.createDataFrame([(n, m, 8) for n, m in masks.items()] + [("null", None, 8)], "n string, mask array<int>, w int")
    change = {r["n"]: r["change"] for r in pixels.window_sum_max(rows, "mask", "w").collect()}
    assert change["none"] == 0 and change["block"] == 9 and change["sparse"] < 5 and change["null"] is None


def test_range_expansion(spark):
    got = spark.range(1).select(pixels.expand_range(F.sequence(F.lit(0), F.lit(255))).alias("x")).first()["x"]
    assert got == [int(np.clip(np.floor((y - 16) * 255 / 219 + 0.5), 0, 255)) for y in range(256)]


def test_array_kernels():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert pixels.resize_bilinear(image, 6, 8) is image
    assert np.allclose(pixels.resize_bilinear(np.full((5, 7), 9.0), 3, 11), 9.0)
    packed = np.concatenate([np.full((5, 6), 100, np.uint8), np.full((3, 6), 128, np.uint8)])
    assert (pixels.nv12_to_rgb(packed, 5, 5) == 97).all()  # 1.164383 * (100 - 16), limited range
    assert pixels.recogniser_input(image, pad_to=80).shape == (1, 48, 80)
    assert pixels.component_share(np.array([[1, 1, 0, 0], [0, 1, 0, 1], [0, 1, 0, 0]])) == (4, 0.8)
    assert pixels.component_share(np.zeros((2, 2))) == (0, 0.0)


def test_gate(spark):
    base = spark.createDataFrame([("a", 4), ("b", 8), ("c", 0)], "run_id string, final long")
    check = lambda rows: [r["passed"] for r in joins.gate(spark.createDataFrame(rows, "run_id string, final long"), base).orderBy(F.col("run_id").asc_nulls_last()).collect()]
    assert all(check([("a", 4), ("b", 8), ("c", 0)]))
    assert all(check([("a", 3), ("b", 8), ("c", 0)]))
    assert check([("a", 5), ("b", 7), ("c", 0)]) == [False, True, True, True]
    assert check([("a", 4), ("b", 8)]) == [True, True, False, True]


def test_stream_of_frames_in_two_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(run, k, rng.choice([5, 5, 6]), rng.random(), k == 29) for run in range(3) for k in range(30)]
    schema = "run_id long, frame int, value int, sharp double, last boolean"
    source = tmp_path / "in"
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] >= 13) == bool(part)], schema).coalesce(1).write.mode("append").parquet(str(source))
    order = sorted((p for p in os.listdir(source) if p.endswith(".parquet")), key=lambda p: os.path.getmtime(source / p))
    assert len(order) == 2
    stream = segmenter.segment_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["run_id"], r["seg"], r["start"], r["end"], r["n"], r["rep"], r["value"]) for r in spark.table("closed").collect())
    want = []
    for run in range(3):
        mine = [r for r in rows if r[0] == run]
        cuts = [0] + [k for k in range(1, 30) if mine[k][2] != mine[k - 1][2]] + [30]
        for seg, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((run, seg, a, b - 1, b - a, max(mine[a:b], key=lambda r: r[3])[1], mine[a][2]))
    assert got == want


def test_split_frames():
    frames_ = list(range(100))
    assert pictures.split_frames(frames_, 10, 0.55) == (frames_[10:55], frames_[55:])
    assert pictures.split_frames(frames_[:30], 50, 0.55) == ([], [])
    assert pictures.split_frames(frames_, 40, 0.1) == ([], frames_[40:])


def test_baseline_round_trip(spark, tmp_path):
    rows = [(1, 5, 1, 1, 0, 0, 0, 0), (None, 5, 1, 1, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "run_id long, seg long, raw long, fix long, fix_wrong long, missed long, harm long, final long")
    logs.write_baseline(df, str(tmp_path / "b"), 1.0, "v1")
    assert sorted(logs.read_baseline(spark, str(tmp_path / "b"), 1.0).collect(), key=str) == sorted(df.collect(), key=str)
    with pytest.raises(ValueError):
        logs.read_baseline(spark, str(tmp_path / "b"), 2.0)


def test_orphans(spark):
    files, manifest = (spark.createDataFrame([(x,) for x in f], "file string") for f in (["a", "b", "c"], ["b", "b", "z"]))
    assert sorted(r["file"] for r in logs.orphans(files, manifest).collect()) == ["a", "c"]


def test_recogniser(spark):
    def load():
        return lambda pictures: [(str(sum(p)), len(p) / 10) for p in pictures]

    df = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [5])], "k int, px array<int>")
    got = {r["k"]: tuple(r["r"]) for r in df.select("k", recognise.recogniser(load, 2)("px").alias("r")).collect()}
    assert got == {1: ("3", 0.2), 2: (None, None), 3: ("5", 0.1)}
