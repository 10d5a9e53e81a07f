"""Medians over a moving window against the definition, row by row."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from seriesmith.operators import series
from seriesmith.params import DEFAULTS


def brute(rows):
    """rows: seg, mid, raw in order of seg."""
    gaps = [b[1] - a[1] for a, b in zip(rows, rows[1:]) if a[1] is not None and b[1] is not None]
    half = min(DEFAULTS.window * max(statistics.median(gaps) if gaps else 1.0, 1.0), float(DEFAULTS.window_max))
    steps = [(b[1], a[1], abs(b[2] - a[2])) for a, b in zip(rows, rows[1:]) if None not in (a[1], b[1], a[2], b[2])]
    out = {}
    for seg, mid, _ in rows:
        near = [d for m, before, d in steps if mid is not None and abs(m - mid) <= half and before >= mid - half]
        out[seg] = float(statistics.median(near)) if near else 0.0
    return out


@pytest.mark.parametrize("records", [7, 10_000])
def test_bandwidth_of_each_row(spark, records):
    rng, runs = random.Random(1), {}
    for run in ("a", "b", "c", None, "e"):
        mid, rows = 0, []
        for seg in range(rng.choice([1, 2, 60, 150])):
            mid += rng.choice([0, 1, 2, 9, 40, 300]) - (5 if rng.random() < 0.05 else 0)
            rows.append((seg, mid, rng.choice([None, *range(0, 200, 7)])))
        runs[run] = rows
    flat = [(run, seg, mid, 1, raw, [seg]) for run, rows in runs.items() for seg, mid, raw in rows]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "run_id string, seg int, mid int, len int, raw int, extra array<int>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        out = series.local_bandwidth(df)
        assert out.columns == [*df.columns, "bw"]
        got = {(r["run_id"], r["seg"]): r["bw"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(run, seg): bw for run, rows in runs.items() for seg, bw in brute(rows).items()}


def test_dense_run_keeps_one_window(spark):
    """20,000 rows at one time: as an array for each row they would be 400 million entries."""
    df = spark.range(20_000).select(F.lit(1).alias("run_id"), F.col("id").cast("int").alias("seg"), F.lit(5).alias("mid"), F.lit(1).alias("len"), (F.col("id") % 3).cast("int").alias("raw"))
    assert [tuple(r) for r in series.local_bandwidth(df).groupBy("bw").count().collect()] == [(1.0, 20_000)]


def test_empty_table(spark):
    assert series.local_bandwidth(spark.createDataFrame([], "run_id long, seg int, mid int, len int, raw int")).count() == 0
