"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

DataFrame functions only. One pass over the texts counts tokens; everything after it works on rows
of (id, source, tokens). The exponent is bisected by sums over the table of sources, many candidates
in one pass, so no row holds all sources; the prefix that a budget buys in a permutation is found from sums over buckets of the permutation
order, so that no task sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.llm.common import ROW_KEY, count_words, join_dealt, join_shuffled, materialize, read_table, row_key, whole_row

#: Parts that a pass cuts the exponent's interval into, and passes; the exponent is then rounded to 9 decimals.
CUTS = 256
PASSES = 6
#: Rows of a source that share one bucket of the permutation order, about.
BUCKET_ROWS = 1000
#: Sources whose plan is broadcast, at some 50 bytes each.
BROADCAST_SOURCES = 10_000


def _exponent(per: DataFrame, all_tokens: int, target_entropy: float, repetition_limit: float, budget: float) -> float:
    """Largest exponent in [0, 1] whose weights reach the target entropy, raised while a source would repeat too often.

    ``per`` has one row per source. Both conditions hold on one side of a crossing, which is narrowed by
    CUTS a pass; a pass is one aggregate with one row per candidate.
    """
    share = per.where("have > 0").select((F.col("have") / F.lit(float(all_tokens))).alias("p"))
    known = share.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least")).first()
    if not known["n"]:
        return 1.0
    goal = target_entropy * math.log(known["n"])

    def sums(candidates: list[float]) -> dict[float, tuple[float, float]]:
        power = F.pow("p", "a")
        rows = share.withColumn("a", F.explode(F.lit(candidates))).groupBy("a").agg(F.sum(power).alias("s"), F.sum(power * F.ln("p")).alias("d")).collect()
        return {r["a"]: (r["s"], r["d"]) for r in rows}  # a few hundred numbers

    def reaches(a: float, s: float, d: float) -> bool:  # the entropy of p^a / s, from d, the sum of p^a log p
        return math.log(s) - a * d / s >= goal

    def within(a: float, s: float, d: float) -> bool:  # reads of the rarest source, budget in units of all tokens
        return budget * known["least"] ** (a - 1.0) / s <= repetition_limit

    ends = sums([0.0, 1.0])
    by_entropy = None if not reaches(1.0, *ends[1.0]) else 1.0
    by_repeats = None if not within(0.0, *ends[0.0]) else 0.0
    spans = {"entropy": (0.0, 1.0), "repeats": (0.0, 1.0)}
    for _ in range(PASSES if by_entropy is None or by_repeats is None else 0):
        grids = {k: [lo + (hi - lo) * i / CUTS for i in range(CUTS + 1)] for k, (lo, hi) in spans.items()}
        found = sums(sorted({a for k, g in grids.items() if (by_entropy if k == "entropy" else by_repeats) is None for a in g[1:-1]}))
        if by_entropy is None:
            at = sum(reaches(a, *found[a]) for a in grids["entropy"][1:-1])
            spans["entropy"] = (grids["entropy"][at], grids["entropy"][at + 1])
        if by_repeats is None:
            at = sum(not within(a, *found[a]) for a in grids["repeats"][1:-1])
            spans["repeats"] = (grids["repeats"][at], grids["repeats"][at + 1])
    return round(max(spans["entropy"][0] if by_entropy is None else by_entropy, spans["repeats"][1] if by_repeats is None else by_repeats), 9)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document and block in which the mixture reads it.

    A source's weight is its token share to the power of an exponent in [0, 1], normalised. The
    exponent is the largest that gives ``target_entropy`` times the largest entropy possible; where
    the rarest source would then be read more than ``repetition_limit`` times, it is raised until it
    is not. ``budget_share`` times all tokens are spent: a source's quota buys whole blocks, each a
    permutation of all its documents (epochs 0, 1, ...), then the longest affordable prefix of the
    next permutation. A token is a maximal run of characters other than ASCII white space.

    A null source counts as the empty name, a null text as empty. A source without tokens has weight
    zero and its documents are read once. Repeated rows are documents of their own; ties in the order
    of a permutation are broken by tokens, then by the text's hash. No rows give no rows.

    Options are those of ``_reads``. Returns doc_id, source, n_tokens, epoch, position_key (md5 that
    orders the block).
    """
    return _reads(docs, **options).drop(*ROW_KEY)


def _reads(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float = 0.95,
    repetition_limit: float = 2.0,
    budget_share: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """What mix_sources returns, with the columns of row_key."""
    tokens = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), count_words(F.col(text_col)).alias("n_tokens"), *row_key(id_col, text_col)
        ),
        "mixing",
    )
    per = materialize(tokens.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n_docs")), "mixing")
    all_tokens = per.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("n")).first()["n"]
    budget, a = math.floor(all_tokens * budget_share), _exponent(per, all_tokens, target_entropy, repetition_limit, budget_share)
    weight = F.when(F.col("have") > 0, F.pow(F.col("have") / F.lit(max(all_tokens, 1)), F.lit(a))).otherwise(0.0)
    known = per.agg(F.sum(weight).alias("s"), F.count(F.lit(1)).alias("n")).first()
    norm = known["s"] or 1.0
    # a share that is whole but for rounding is whole
    quota = F.floor(F.lit(budget) * weight / F.lit(norm) + 1e-6).cast("long")
    plan = (
        per.withColumn("quota", quota)
        .withColumn("full", F.when(F.col("have") > 0, F.floor(F.col("quota") / F.col("have"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("quota") - F.col("full") * F.col("have"))
        .select("source", "full", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long").alias("buckets"))
    )
    # the number of sources has been counted: few of them go to every task, many are joined by shuffle
    rows = tokens.join(F.broadcast(plan), "source") if known["n"] <= BROADCAST_SOURCES else join_dealt(tokens, plan, ["source"])

    def key(epoch):
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("doc_id").cast("string")))

    columns = ["doc_id", "source", "n_tokens", "epoch", "position_key", *ROW_KEY]
    whole = rows.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).withColumn("position_key", key(F.col("epoch")))
    part = (
        rows.withColumn("epoch", F.col("full"))
        .withColumn("position_key", key(F.col("epoch")))
        .withColumn("bucket", F.floor(F.conv(F.substring("position_key", 1, 8), 16, 10).cast("double") * F.col("buckets") / 4294967296.0))
    )
    ends = (
        part.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
        .withColumn("end", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")))
        .select("source", "bucket", "end", (F.col("end") - F.col("in_bucket")).alias("start"))
    )
    placed = join_dealt(part, ends, ["source", "bucket"])
    inside = placed.where("end <= rest")
    order = Window.partitionBy("source", "bucket").orderBy("position_key", "n_tokens", "k_a", "k_b").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.where("end > rest and start <= rest").withColumn("upto", F.col("start") + F.sum("n_tokens").over(order)).where("upto <= rest")
    return whole.select(columns).unionByName(inside.select(columns)).unionByName(border.select(columns))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents as the mixture reads them, once per block, with the columns of ``docs``.

    Rows are told apart by id, source and text, so each is read as often as the mixture reads it. Of
    rows that repeat all three, as many are read in a block as it has of them.
    """
    reads = _reads(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    keys = [*ROW_KEY, "k_source"]
    in_block = reads.withColumnRenamed("source", "k_source").groupBy(*keys, "epoch").agg(F.count(F.lit(1)).alias("copies"))
    times = in_block.groupBy(*keys).agg(F.collect_list("copies").alias("blocks"))  # one number a block
    rows = docs.select(whole_row(docs), *row_key(id_col, text_col), F.coalesce(F.col(source_col), F.lit("")).alias("k_source"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("k_a")))
    joined = join_shuffled(rows, times, keys)  # on the window's keys, so the texts are shuffled once
    read = F.size(F.filter("blocks", lambda n: n >= F.col("copy")))
    return joined.withColumn("__read", F.explode(F.array_repeat(F.lit(0), read))).select("row.*")


def op10_mixing(spark, sf_dir) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
per AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS have FROM t GROUP BY source),
s AS (SELECT CAST(sum(have) AS BIGINT) AS total, list_sort(list(have) FILTER (have > 0)) AS each FROM per),
p AS (SELECT total, list_transform(each, lambda x: x / total::DOUBLE) AS p FROM s),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))))
               - (lo + hi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x)))
                 / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) >= 0.95 * ln(len(p)) AS ok
        FROM bis, p WHERE i < 50)),
rep(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               pow(list_min(p), (lo + hi) / 2 - 1) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) <= 2.0 AS ok
        FROM rep, p WHERE i < 50)),
al AS (
  SELECT round(greatest(
    CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.95 * ln(len(p)) THEN 1.0 ELSE (SELECT lo FROM bis WHERE i = 50) END,
    CASE WHEN 1 / list_min(p) / len(p) <= 2.0 THEN 0.0 ELSE (SELECT hi FROM rep WHERE i = 50) END), 9) AS a, total
  FROM p),
w AS (SELECT source, have, total, CASE WHEN have > 0 THEN pow(have / total::DOUBLE, a) ELSE 0 END AS w FROM per, al),
q AS (SELECT source, have, CAST(floor(total * w / sum(w) OVER () + 1e-6) AS BIGINT) AS quota FROM w),
f AS (SELECT source, have, quota, CASE WHEN have > 0 THEN quota // have ELSE 0 END AS n_full FROM q),
r AS (SELECT t.*, n_full, quota - n_full * have AS rest FROM t JOIN f USING (source)),
whole AS (
  SELECT doc_id, source, n_tokens, CAST(e AS INTEGER) AS epoch, md5('17:' || e || ':' || doc_id) AS position_key
  FROM (SELECT r.*, unnest(range(n_full)) AS e FROM r)),
part AS (
  SELECT doc_id, source, n_tokens, CAST(n_full AS INTEGER) AS epoch, md5('17:' || n_full || ':' || doc_id) AS position_key, rest FROM r),
cum AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY position_key, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM part)
SELECT doc_id, source, n_tokens, epoch, position_key FROM whole
UNION ALL
SELECT doc_id, source, n_tokens, epoch, position_key FROM cum WHERE upto <= rest
"""
