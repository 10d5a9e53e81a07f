"""The repair of a run from readings to a log, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.numeric import flag
from seriesmith.operators import islands, joins, series, viterbi
from seriesmith.params import DEFAULTS, Params


def score(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds bw, conf, branch, anchor, fill."""
    scored = islands.cap_islands(series.confidence(series.local_bandwidth(readings, p), p), p)
    return series.fill_curve(series.anchors(scored, p), p)


def repair(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds to score(): corr, the smoothed reading, and final, after the pass for spikes."""
    return series.spike_pass(viterbi.smooth(score(readings, p), p), "corr", p).withColumnRenamed("spiked", "final")


def log_rows(repaired: DataFrame, p: Params = DEFAULTS, pinned: DataFrame | None = None) -> DataFrame:
    """One row per frame: run_id, frame, dist, speed, flag. Frames number the run's segments one after the other."""
    out = repaired if pinned is None else repaired.join(pinned.select("run_id", "seg", F.lit(True).alias("_pin")), ["run_id", "seg"], "left")
    pin = F.lit(False) if pinned is None else F.coalesce("_pin", F.lit(False))
    start = F.sum("len").over(Window.partitionBy("run_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")
    rows = (
        out.withColumn("flag", flag(F.col("raw"), F.col("final"), F.col("conf"), pin, p))
        .withColumn("_start", start.cast("int"))
        .withColumn("frame", F.explode(F.sequence("_start", F.col("_start") + F.col("len") - 1)))
        .withColumn("speed", F.coalesce("final", F.lit(-1)))
    )
    return series.distance(rows, "frame", "speed", p.fps).select("run_id", "frame", "dist", "speed", "flag")


def finalize(repaired: DataFrame, edits: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The log again with the user's values in place and flagged as pinned; edits of no segment are ignored.

    An edit may come more than once for a segment only with one value.
    """
    one = edits.groupBy("run_id", "seg").agg(F.max("value").alias("value"))
    out = joins.overlay(repaired.withColumnRenamed("final", "value"), one).withColumnRenamed("value", "final")
    pinned = out.where("pinned").select("run_id", "seg")
    return log_rows(out.drop("pinned"), p, pinned)


def finalize_values(repaired: DataFrame, values: DataFrame, pinned: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """The log again with whole lists of values: run_id and values, one for each of the run's segments in order.

    A run that ``values`` does not name keeps its own. The query fails if a list is longer or shorter
    than its run, or its run does not exist. ``pinned``: run_id and seg of values that the user set.
    """
    at = (F.row_number().over(Window.partitionBy("run_id").orderBy("seg")) - 1).alias("_at")
    rows = repaired.select("*", at, F.lit(True).alias("_row"))
    each = values.select("run_id", F.posexplode_outer("values").alias("_at", "_value"))
    each = each.withColumn("_at", F.coalesce("_at", F.lit(0))).withColumn("_given", F.lit(True))
    named = values.select("run_id", F.lit(True).alias("_named"), F.size("values").alias("_size")).dropDuplicates(["run_id"])
    both = rows.join(each, ["run_id", "_at"], "full").join(named, "run_id", "left")
    wrong = F.col("_named") & (F.col("_row").isNull() | F.col("_given").isNull() | (F.col("_at") >= F.col("_size")))
    told = F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(": "), F.col("_size").cast("string"), F.lit(" values are not one for each segment"))
    final = F.when(wrong, F.raise_error(told).cast("int")).when(F.col("_named"), F.bround("_value", 0).cast("int")).otherwise(F.col("final"))
    out = both.withColumn("final", final).drop("_at", "_row", "_value", "_given", "_named", "_size")
    return log_rows(out, p, pinned)


def change_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per run, segments whose value is new and differs from the old one."""
    both = before.select("run_id", "seg", F.col("final").alias("old")).join(after.select("run_id", "seg", F.col("final").alias("new")), ["run_id", "seg"])
    changed = F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    return both.groupBy("run_id").agg(F.sum(changed.cast("long")).alias("changed"))
