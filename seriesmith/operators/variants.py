"""Other forms of detection, scoring and grading, to be compared with those of ``series``.

The same rows and the same windows by run as there. All need bw, but where it is said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.numeric import array_median
from seriesmith.operators import series
from seriesmith.operators.evaluation import TOLERANCE, count_if
from seriesmith.params import DEFAULTS, Params


def pair_expectation(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds expected: median over all pairs of a reading before and one after, of the line between them at mid.

    The window in time is that of the bandwidth: ``window`` median gaps of the run, at most ``window_max``.
    Pairs less than a thousandth apart are left out; null if no pair is left.
    """
    around = Window.partitionBy("run_id").orderBy("mid")
    point = F.when(F.col("raw").isNotNull(), F.struct(F.col("mid").alias("t"), F.col("raw").cast("double").alias("v"), F.col("seg").alias("s")))
    out = series.half_width(df, p).withColumns(
        {
            "_l": F.collect_list(point).over(around.rangeBetween(-p.window_max, 0)),
            "_r": F.collect_list(point).over(around.rangeBetween(0, p.window_max)),
        }
    )
    left = F.filter("_l", lambda x: (x["s"] < F.col("seg")) & (F.col("mid") - x["t"] <= F.col("_half")))
    right = F.filter("_r", lambda x: (x["s"] > F.col("seg")) & (x["t"] - F.col("mid") <= F.col("_half")))

    def line(a: Column, b: Column) -> Column:
        span = b["t"] - a["t"]
        return F.when(span >= 1e-3, a["v"] + (b["v"] - a["v"]) * (F.col("mid") - a["t"]) / span)

    pairs = F.flatten(F.transform("_left", lambda a: F.transform("_right", lambda b: line(a, b))))
    out = out.withColumn("_left", left).withColumn("_right", right)
    # a column of its own, that the median does not make the pairs anew for each use
    out = out.withColumn("_pairs", F.filter(pairs, lambda x: x.isNotNull()))
    return out.withColumn("expected", array_median(F.col("_pairs"))).drop("_l", "_r", "_left", "_right", "_pairs", "_half", "_pm")


def detect_pairs(df: DataFrame, p: Params = DEFAULTS, jump_floor: float | None = None) -> DataFrame:
    """Adds suspect: missing, without a pair about it, or far from what the pairs expect. Needs bw and expected.

    With ``jump_floor`` also a reading that is twice the gate, with that floor of the bandwidth, from a neighbour.
    """
    gate = lambda floor: F.greatest("bw", F.lit(floor)) * p.multiplier
    out = F.col("raw").isNull() | F.col("expected").isNull() | (F.abs(F.col("raw") - F.col("expected")) > gate(p.floor))
    if jump_floor is not None:
        step = F.greatest(F.abs(F.col("raw") - F.lag("raw").over(series.run_order())), F.abs(F.col("raw") - F.lead("raw").over(series.run_order())))
        out = out | F.coalesce(step > gate(jump_floor) * 2, F.lit(False))
    return df.withColumn("suspect", out)


def ungated_confidence(df: DataFrame, p: Params = DEFAULTS, weight_median: float = 0.5, weight_jerk: float = 0.5, jerk_scale: float = 5.0) -> DataFrame:
    """Adds conf: the weighted mean of both scores for every reading, however well it fits; no jerk where a neighbour is missing."""
    jerk = F.coalesce(F.abs(F.lead("raw").over(series.run_order()) - 2 * F.col("raw") + F.lag("raw").over(series.run_order())), F.lit(0))
    fit = F.exp(-F.abs(F.col("raw") - F.col("_med")) / F.greatest("bw", F.lit(p.floor)))
    mixed = F.lit(100.0) * (F.lit(weight_median) * fit + F.lit(weight_jerk) * F.exp(-F.col("_jerk") / jerk_scale))
    conf = (
        F.when(F.col("raw").isNull(), 0.0)
        .when(F.col("_n") < p.least_neighbours, p.short_confidence)
        .when((F.col("_nl") == 0) | (F.col("_nr") == 0), p.edge_confidence)
        .otherwise(mixed)
    )
    return series.context(df, p).withColumn("_jerk", jerk).withColumn("conf", conf).drop("_med", "_n", "_nl", "_nr", "_jerk")


def residual_score(df: DataFrame, column: str = "value", half: int = 7, floor: float = 1.0) -> DataFrame:
    """Adds smooth, bw_smooth and score; needs no bw.

    smooth is the sliding median, bw_smooth the sliding median of its steps, at least ``floor``. The score
    falls with the distance from smooth in units of it; negative values score 0, those that are no number 50.
    """
    out = series.sliding(df, column, half, name="smooth")
    out = out.withColumn("_step", F.coalesce(F.abs(F.col("smooth") - F.lag("smooth").over(series.run_order())), F.lit(0.0)))
    out = series.sliding(out, "_step", half, name="_steps").withColumn("bw_smooth", F.greatest("_steps", F.lit(floor)))
    v = F.col(column).cast("double")
    score = F.when(v < 0, 0.0).otherwise(F.coalesce(F.nanvl(F.lit(100.0) * F.exp(-F.abs(v - F.col("smooth")) / F.col("bw_smooth")), F.lit(50.0)), F.lit(50.0)))
    return out.withColumn("score", F.round(score, 1)).drop("_step", "_steps")


def combine_signals(signals: list[tuple[Column, float]], gates: list[tuple[Column, float, float]]) -> Column:
    """Weighted sum of scores within 0..100; where a gate's column is below its bound, at most its cap."""
    total = sum((c * w for c, w in signals[1:]), signals[0][0] * signals[0][1])
    caps = [F.when(c < bound, F.lit(float(cap))).otherwise(100.0) for c, bound, cap in gates]
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0), *caps)


def detection_rates(df: DataFrame, score: str = "conf", threshold: float = 70.0, tolerance: float = TOLERANCE) -> DataFrame:
    """Per run and, with a null run, in all: percent of errors and of good rows below the threshold, and of all rows.

    A score that is missing or no number is 50. A share of no rows is null. Errors and good rows need raw and truth. Needs no bw.
    """
    known = F.col("raw").isNotNull() & F.col("truth").isNotNull()
    wrong = F.abs(F.col("raw") - F.col("truth")) > tolerance
    low = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(50.0)), F.lit(50.0)) < threshold
    out = df.rollup("run_id").agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(known & wrong).alias("errors"),
        count_if(known & ~wrong).alias("good"),
        count_if(known & wrong & low).alias("_d"),
        count_if(known & ~wrong & low).alias("_f"),
        count_if(low).alias("_a"),
    )
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) * 100.0 / F.col(n))
    return out.select("run_id", "rows", "errors", "good", share("_d", "errors").alias("detected"), share("_f", "good").alias("false_alarms"), share("_a", "rows").alias("flagged"))


def region_gain(df: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    """Per run: y of the last row with x up to ``high``, less y of the first row with x from ``low`` on; needs no bw.

    Rows without x or y are left out; of equal x the lesser y counts as first. Null if either row is missing.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    last = F.max_by(y, F.when(F.col(x) <= high, F.struct(x, y)))
    first = F.min_by(y, F.when(F.col(x) >= low, F.struct(x, y)))
    return rows.groupBy("run_id").agg((last - first).alias("gain"))
