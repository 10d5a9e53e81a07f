"""Short islands of agreeing readings that stand apart from their surroundings.

A run about a row is grown to the left while its range stays within a tolerance, then to the right;
it depends on the row it starts from. Only runs of a few frames matter here, and every row has at
least one frame, so a frame of as many rows on each side holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.numeric import array_median
from seriesmith.operators.series import islands_of, run_order
from seriesmith.params import DEFAULTS, Params


def _grow(state: Column, side: Column, tolerance: float) -> Column:
    """Extends a run over the rows of one side, nearest first."""

    def step(acc, row):
        low, high = F.least(acc["low"], row["raw"]), F.greatest(acc["high"], row["raw"])
        go = acc["open"] & row["raw"].isNotNull() & (high - low <= tolerance)  # least and greatest pass over nulls
        return F.struct(
            F.when(go, low).otherwise(acc["low"]).alias("low"),
            F.when(go, high).otherwise(acc["high"]).alias("high"),
            (acc["frames"] + F.when(go, row["len"]).otherwise(0)).alias("frames"),
            F.when(go, F.concat(acc["vals"], F.array(row["raw"]))).otherwise(acc["vals"]).alias("vals"),
            go.alias("open"),
        )

    return F.aggregate(side, state, step)


def run_bounds(df: DataFrame, tolerance: float, reach: int) -> DataFrame:
    """Adds run_l and run_r (seg), run_frames, run_med, run_exact: the run about each reading, seen ``reach`` rows far."""
    side = lambda a, b: F.collect_list(F.struct("raw", "len")).over(run_order().rowsBetween(a, b))
    start = F.struct(
        F.col("raw").alias("low"), F.col("raw").alias("high"), F.col("len").alias("frames"), F.array("raw").alias("vals"), F.col("raw").isNotNull().alias("open")
    )
    reopened = lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"), s["frames"].alias("frames"), s["vals"].alias("vals"), F.col("raw").isNotNull().alias("open"))
    out = (
        df.withColumn("_left", F.reverse(side(-reach, -1)))
        .withColumn("_right", side(1, reach))
        .withColumn("_gl", _grow(start, F.col("_left"), tolerance))
        .withColumn("_g", _grow(reopened(F.col("_gl")), F.col("_right"), tolerance))
    )
    nl = F.size("_gl.vals") - 1
    return (
        out.withColumn("run_l", F.col("seg") - nl)
        .withColumn("run_r", F.col("seg") + F.size("_g.vals") - 1 - nl)
        .withColumn("run_frames", F.when(F.col("raw").isNull(), 0).otherwise(F.col("_g.frames")))
        .withColumn("run_med", F.when(F.col("raw").isNotNull(), array_median(F.transform("_g.vals", lambda x: x.cast("double")))))
        .withColumn("run_exact", F.col("_g.low") == F.col("_g.high"))
        .drop("_left", "_right", "_gl", "_g")
    )


def exact_bounds(df: DataFrame) -> DataFrame:
    """Adds run_l and run_r (seg) and run_frames: the whole run of equal readings about each one, however long.

    A missing reading is a run of its own without frames.
    """
    w = Window.partitionBy("run_id", "_island")
    of_run = lambda whole, alone: F.when(F.col("raw").isNotNull(), whole.over(w)).otherwise(alone)
    return (
        islands_of(df, F.col("raw"), name="_island")
        .withColumn("run_l", of_run(F.min("seg"), F.col("seg")))
        .withColumn("run_r", of_run(F.max("seg"), F.col("seg")))
        .withColumn("run_frames", of_run(F.sum("len"), F.lit(0)))
        .drop("_island")
    )


def cap_islands(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Lowers conf of every reading in a short run far from the median of the rows around it. Needs bw, conf, branch."""
    reach = max(p.island_frames, p.island_frames_exact)
    out = run_bounds(df, p.island_tolerance, reach)
    k = p.neighbours
    around = F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("seg", F.col("raw").cast("double").alias("raw")))).over(run_order().rowsBetween(-k, k))
    least = F.when(F.col("run_exact"), p.island_frames_exact).otherwise(p.island_frames)
    outside = F.transform(F.filter("_around", lambda x: (x["seg"] < F.col("run_l")) | (x["seg"] > F.col("run_r"))), lambda x: x["raw"])
    eligible = F.col("raw").isNotNull() & F.col("branch").isin("fit", "jerk")
    far = F.abs(F.col("run_med") - array_median(F.col("_outside"))) > F.greatest("bw", F.lit(p.floor)) * p.island_deviation
    seeds = F.collect_list(F.struct("_cap", "run_l", "run_r")).over(run_order().rowsBetween(-reach, reach))
    return (
        out.withColumn("_around", around)
        .withColumn("_outside", outside)
        .withColumn("_cap", F.coalesce(eligible & (F.col("run_frames") < least) & (F.size("_outside") >= p.least_neighbours) & far, F.lit(False)))
        .withColumn("_seeds", seeds)
        .withColumn(
            "conf",
            F.when(eligible & F.exists("_seeds", lambda s: s["_cap"] & F.col("seg").between(s["run_l"], s["run_r"])), F.least("conf", F.lit(p.island_cap))).otherwise(F.col("conf")),
        )
        .drop("_around", "_outside", "_cap", "_seeds", "run_l", "run_r", "run_frames", "run_med", "run_exact")
    )
