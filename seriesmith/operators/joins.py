"""Joins in order: nearest rows, interpolation between curves, intervals, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.numeric import array_median, lerp
from seriesmith.operators.series import next_value


def asof_points(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Left rows with _p and _n: (x, v) of the nearest right row at or before, and after, in the order of ``on``.

    A union and two window functions: one shuffle, no inequality join.
    """
    points = right.select(*by, F.col(on).cast("double").alias("_x"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumn("_x", F.col(on).cast("double")).withColumn("_v", F.lit(None).cast("double")).withColumn("_side", F.lit(1))
    point = F.when(F.col("_side") == 0, F.struct(F.col("_x").alias("x"), F.col("_v").alias("v")))
    w = Window.partitionBy(*by).orderBy("_x", "_side")
    both = rows.unionByName(points, allowMissingColumns=True)
    # right rows come first among equals, so after a left row only greater ones follow
    return (
        both.withColumn("_p", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", next_value(point, by, F.col("_x").desc(), F.col("_side").desc()))
        .where("_side = 1")
        .drop("_x", "_v", "_side")
    )


def interpolate_onto(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, name: str) -> DataFrame:
    """Adds name: the right curve at each left row, held constant beyond its ends."""
    out = asof_points(left, right, by, on, value)
    x = F.col(on).cast("double")
    inside = F.when(F.col("_p.x") == x, F.col("_p.v")).otherwise(lerp(x, F.col("_p.x"), F.col("_p.v"), F.col("_n.x"), F.col("_n.v")))
    return out.withColumn(name, F.when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), inside).otherwise(F.coalesce("_p.v", "_n.v"))).drop("_p", "_n")


def nearest_onto(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, name: str) -> DataFrame:
    """Adds name: the value of the right row nearest in ``on``; of two as near the one after."""
    out = asof_points(left, right, by, on, value)
    x = F.col(on).cast("double")
    before = (F.col("_p.x") == x) | F.col("_n").isNull() | (F.abs(F.col("_p.x") - x) < F.abs(F.col("_n.x") - x))
    return out.withColumn(name, F.when(F.coalesce(before, F.lit(False)), F.col("_p.v")).otherwise(F.col("_n.v"))).drop("_p", "_n")


def median_of_pairs(df: DataFrame, half: int, rows: int | None = None) -> DataFrame:
    """Adds expected: median over all pairs of a reading before and one after, of the line between them at mid.

    All readings at most ``half`` time units away, of these only those at most ``rows`` rows away if given.
    """
    run = Window.partitionBy("run_id")
    point = F.when(F.col("raw").isNotNull(), F.struct(F.col("mid").alias("t"), F.col("raw").cast("double").alias("v"), F.col("seg").alias("s")))
    if rows is None:
        around = run.orderBy("mid")
        out = df.withColumn("_l", F.collect_list(point).over(around.rangeBetween(-half, 0))).withColumn("_r", F.collect_list(point).over(around.rangeBetween(0, half)))
        out = out.withColumn("_l", F.filter("_l", lambda x: x["s"] < F.col("seg"))).withColumn("_r", F.filter("_r", lambda x: x["s"] > F.col("seg")))
    else:
        around = run.orderBy("seg")
        near = lambda a: F.filter(a, lambda x: F.abs(x["t"] - F.col("mid")) <= half)
        out = df.withColumn("_l", near(F.collect_list(point).over(around.rowsBetween(-rows, -1)))).withColumn("_r", near(F.collect_list(point).over(around.rowsBetween(1, rows))))
    pairs = F.flatten(F.transform("_l", lambda a: F.transform("_r", lambda b: lerp(F.col("mid"), a["t"], a["v"], b["t"], b["v"]))))
    # a column of its own, that the median does not make the pairs anew for each use
    return out.withColumn("_pairs", pairs).withColumn("expected", array_median(F.col("_pairs"))).drop("_l", "_r", "_pairs")


def expand_frames(segments: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per frame of each segment."""
    return segments.withColumn("frame", F.explode(F.sequence(F.col(start), F.col(end))))


def containing_segment(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Each frame with the segment [start, end] that holds it: the last one that starts at or before it, if it reaches."""
    ends = segments.select("run_id", F.col("start").alias("frame"), F.struct("seg", "end").alias("_s"), F.lit(0).alias("_side"))
    rows = frames.withColumn("_side", F.lit(1))
    w = Window.partitionBy("run_id").orderBy("frame", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(ends, allowMissingColumns=True).withColumn("_h", F.last("_s", ignorenulls=True).over(w)).where("_side = 1")
    return both.withColumn("seg", F.when(F.col("_h.end") >= F.col("frame"), F.col("_h.seg"))).drop("_s", "_side", "_h")


def containing_segments(frames: DataFrame, segments: DataFrame, how: str = "inner") -> DataFrame:
    """Each frame with every segment [start, end] that holds it: segments may nest and overlap.

    Bins instead of an inequality join. A segment's bins are as wide as the next power of two above its
    length, so it lies in two of them at most, long or short; a frame looks into one bin for each
    width that its run has. ``how`` "left" keeps frames that no segment holds, with nulls. Segments that
    end before they start hold nothing. Segments have run_id, start, end and what is to be added to frames.
    """
    added = [c for c in segments.columns if c not in ("run_id", "start", "end")]
    bits = lambda n: F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))
    held = segments.where("start <= end").withColumn("_level", bits(F.col("end").cast("long") - F.col("start").cast("long") + 1))
    bin_of = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), _level)")  # noqa: E731  rounds down, below zero too
    held = held.select("run_id", "_level", F.explode(F.array_distinct(F.array(bin_of("start"), bin_of("end")))).alias("_bin"), F.struct("start", "end", *added).alias("_s"))
    levels = held.groupBy("run_id").agg(F.collect_set("_level").alias("_levels"))
    spread = frames.join(levels, "run_id").withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_bin", bin_of("frame"))
    hits = spread.join(held, ["run_id", "_level", "_bin"]).where(F.col("frame").between(F.col("_s.start"), F.col("_s.end")))
    out = hits.select(*frames.columns, *[F.col(f"_s.{c}") for c in added])
    if how == "inner":
        return out
    none = [F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in added]
    alone = frames.join(out.select("run_id", "frame").distinct(), ["run_id", "frame"], "left_anti")
    return out.unionByName(alone.select(*frames.columns, *none))


def overlay(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with the user's values in place; edits of segments that do not exist are ignored."""
    last = edits.select("run_id", "seg", F.col("value").alias("_e"))
    out = segments.join(last, ["run_id", "seg"], "left")
    return out.withColumn("value", F.coalesce(F.bround("_e", 0).cast("int"), F.col("value"))).withColumn("pinned", F.col("_e").isNotNull()).drop("_e")


def gate(result: DataFrame, baseline: DataFrame, by: str = "run_id", metric: str = "final") -> DataFrame:
    """Each baseline row with the result: missing, regressed or passed; the total is one row more with a null key.

    The gate holds if ``passed`` is true in every row.
    """
    per = baseline.select(by, F.col(metric).alias("base")).join(result.select(by, F.col(metric).alias("now")), by, "left")
    per = per.select(by, "base", "now")
    total = per.agg(F.sum("base").alias("base"), F.sum("now").alias("now")).select(F.lit(None).cast(result.schema[by].dataType).alias(by), "base", "now")
    return per.unionByName(total).withColumn("passed", F.coalesce(F.col("now") <= F.col("base"), F.lit(False)))
