"""Mergeable sketches of a run's readings: quantiles (KLL) and numbers of different values (HLL).

A sketch has a bounded size whatever it has seen. Sketches of runs are stored as a table and merged
into those of larger groups, without reading the runs again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameters of the sketches, and the errors that they are held to: of a rank, as a share of all
#: values, and of a number of different values, as a share of it.
KLL_K, HLL_LG_K = 1024, 12
RANK_ERROR, DISTINCT_ERROR = 0.02, 0.1
#: Sketches that are merged in one group of one round.
FAN = 64


def sketch(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, quantiles and distinct: the sketches of the values that are not null, made on the map side first."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v.cast("double"), F.lit(KLL_K)).alias("quantiles"), F.hll_sketch_agg(v.cast("long"), F.lit(HLL_LG_K)).alias("distinct"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of each group of ``by`` as one; [] merges all.

    Rounds of groups of about FAN sketches each, so no task holds all of them.
    """
    rounds = max(1, math.ceil(math.log(max(2, sketches.count()), FAN)))
    now = sketches.where("n > 0").select(*by, "n", "quantiles", "distinct", F.xxhash64("quantiles", F.monotonically_increasing_id()).alias("_h"))
    for k in range(rounds - 1, -1, -1):
        rest = F.slice("_all", 2, F.size("_all"))
        grouped = now.groupBy(*by, F.pmod("_h", F.lit(FAN**k)).alias("_h")).agg(F.sum("n").alias("n"), F.collect_list("quantiles").alias("_all"), F.hll_union_agg("distinct").alias("distinct"))
        now = grouped.select(*by, "n", F.aggregate(rest, F.get("_all", F.lit(0)), F.kll_sketch_merge_double).alias("quantiles"), "distinct", "_h")
    return now.drop("_h")


def quantile(sketch_col: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch_col), F.lit(float(share)))


def different(sketch_col: str) -> Column:
    return F.hll_sketch_estimate(F.col(sketch_col))
