"""Grading of detection and repair against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1.0
METRICS = ("raw", "fix", "fix_wrong", "missed", "harm", "final")


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def outcomes(df: DataFrame, tolerance: float = TOLERANCE, raw: str = "raw", corr: str = "corr", truth: str = "truth") -> DataFrame:
    """Rows with raw and truth, and for each metric of the funnel whether the row counts for it."""
    r, c, t = F.col(raw), F.col(corr), F.col(truth)
    raw_err = F.abs(r - t) > tolerance
    final_err = c.isNull() | (F.abs(c - t) > tolerance)
    changed = c.isNotNull() & (c != r)
    return df.where(r.isNotNull() & t.isNotNull()).withColumns(
        {
            "is_raw": raw_err,
            "is_fix": raw_err & changed & ~final_err,
            "is_fix_wrong": raw_err & changed & final_err,
            "is_missed": raw_err & ~changed,
            "is_harm": ~raw_err & changed & final_err,
            "is_final": final_err,
        }
    )


def funnel(df: DataFrame, **columns) -> DataFrame:
    """Counts per run and, with a null run, in all: rows, raw errors, and what became of them."""
    marked = outcomes(df, **columns)
    return marked.rollup("run_id").agg(F.count(F.lit(1)).alias("seg"), *[count_if(F.col(f"is_{m}")).alias(m) for m in METRICS])


def confusion(df: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Detection per run and in all: tp, fn, fp, tn, recall and false-positive rate over at least one."""
    rows = df.where(F.col("raw").isNotNull() & F.col("truth").isNotNull()).withColumn("_e", F.abs(F.col("raw") - F.col("truth")) > tolerance)
    s = F.col("suspect")
    out = rows.rollup("run_id").agg(
        count_if(F.col("_e") & s).alias("tp"), count_if(F.col("_e") & ~s).alias("fn"), count_if(~F.col("_e") & s).alias("fp"), count_if(~F.col("_e") & ~s).alias("tn")
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    return out.withColumn("recall", rate("tp", "fn")).withColumn("fpr", rate("fp", "tn"))


#: Upper bounds of the error classes, and their names.
ERROR_CLASSES = ((1.5, "1"), (2.5, "2"), (5.0, "3-4"), (10.0, "5-9"), (20.0, "10-19"))


def error_class(error: Column) -> Column:
    out = F.lit("20+")
    for bound, name in reversed(ERROR_CLASSES):
        out = F.when(error < bound, name).otherwise(out)
    return out


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "conf", tolerance: float = TOLERANCE) -> DataFrame:
    """For each threshold the errors and the good rows that score below it; one pass, no join."""
    rows = df.where(F.col("raw").isNotNull() & F.col("truth").isNotNull()).withColumn("_e", F.abs(F.col("raw") - F.col("truth")) > tolerance)
    below = lambda t: F.col(score) < t
    sums = [F.struct(F.lit(t).alias("threshold"), count_if(F.col("_e") & below(t)).alias("caught"), count_if(~F.col("_e") & below(t)).alias("false_alarms")) for t in thresholds]
    total = [count_if(F.col("_e")).alias("errors"), count_if(~F.col("_e")).alias("good")]
    wide = rows.agg(F.array(*sums).alias("s"), *total)
    return wide.select(F.inline("s"), "errors", "good").withColumn("recall", F.col("caught") / F.greatest("errors", F.lit(1))).withColumn(
        "fpr", F.col("false_alarms") / F.greatest("good", F.lit(1))
    )


def best_threshold(sweep: DataFrame, most_fpr: float) -> DataFrame:
    """The lowest threshold of the greatest recall among those within the false-positive rate."""
    return sweep.where(F.col("fpr") <= most_fpr).agg(F.max_by("threshold", F.struct("recall", (-F.col("threshold")).alias("t"))).alias("threshold"), F.max("recall").alias("recall"))
