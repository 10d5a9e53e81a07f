"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step replaces the edges by as many or fewer; only edges live in Spark, nothing is collected but
two numbers per round. Every round is written to the shared folder, so the lineage stays short.
A node with very many edges is aggregated on the map side, and its join partition is split by
adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import discard, join_dealt, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return join_dealt(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_dealt(down, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) in; (node, root) out for every node that has an edge, the root being its component's smallest node.

    Nulls and loops are dropped, repeated edges count once; no edges give no rows.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "components")
    seen = None
    while True:
        before, now = now, materialize(_small_star(_large_star(now)), "components")
        for path in {f.rsplit("/", 1)[0] for f in before.inputFiles()}:
            discard(path)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
