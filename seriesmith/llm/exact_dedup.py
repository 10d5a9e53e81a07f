"""Exact dedup: groups by a 128-bit content hash, bytes compared inside the groups.

DataFrame functions only. One pass writes (id, points, hash) of each row; groups, the row that stays
and the group sizes come from that narrow table. The bytes of the rows in groups are then held against
one text that stays, in a join by hash in which a large group is salted by row; a hash under which
texts differ, next to never any, is taken apart by the texts themselves. Otherwise no text is a grouping
key, and the texts are shuffled once, to the hashes of groups; those of groups once more, to the text that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import ROW_KEY, join_dealt, join_shuffled, materialize, read_table, row_key, strip_spaces, without_rows

#: Hexadecimal digits of the SHA-256 that make up the 128-bit content hash.
HASH_DIGITS = 32
#: Rows of one group whose bytes are compared under one salt.
SALT_ROWS = 500


def _content_hash(sha256: Column) -> Column:
    return F.unhex(F.substring(sha256, 1, HASH_DIGITS))


def _best() -> Column:
    """Most code points, then smallest id, a null id last; of any type that has an order."""
    return F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id")))


def _decided(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the best row of its group, groups of one included."""
    alone = F.col("best").isNull()
    stays = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.less"))
    return join_dealt(rows, groups, keys, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | stays).alias("kept"),
        "text_sha256",
        *ROW_KEY,
    )


def _decisions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What exact_dedup returns, with the columns of row_key."""
    texts = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), strip_spaces(F.col(text_col)).alias("norm"))
    texts = texts.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("content_hash", _content_hash(F.col("text_sha256")))
    rows = materialize(texts.drop("norm"), "exact-dedup")
    several = materialize(rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), _best().alias("best")).where("n > 1"), "exact-dedup")
    # bytes: every row of a group against one text of it, which is copied once for each salt
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    members = join_shuffled(texts.drop("text_sha256"), several, ["content_hash"]).withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    members = materialize(members.drop(*ROW_KEY), "exact-dedup")
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.less")))
    one = stays.groupBy("content_hash").agg(F.min("norm").alias("other"), F.first("n").alias("n"))  # rows that repeat the one that stays become one before they are copied
    chosen = one.select("content_hash", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "other")
    compared = join_shuffled(members.select("content_hash", "salt", "norm"), chosen, ["content_hash", "salt"])
    mixed = materialize(compared.where("norm <> other").select("content_hash").distinct(), "exact-dedup")
    # a hash under which texts differ: next to never any row
    apart = texts.join(F.broadcast(mixed), "content_hash", "left_semi") if mixed.isEmpty() else join_dealt(texts, mixed, ["content_hash"], "left_semi")
    exact = _decided(apart, apart.groupBy("content_hash", "norm").agg(F.count(F.lit(1)).alias("n"), _best().alias("best")), ["content_hash", "norm"])
    sure = rows.join(F.broadcast(mixed), "content_hash", "left_anti") if mixed.isEmpty() else join_dealt(rows, mixed, ["content_hash"], "left_anti")
    return _decided(sure, several, ["content_hash"]).unionByName(exact)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the document that stays in its place.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the row with the
    most code points stays, then the smallest id, which may be of any type that has an order. A null
    text is an empty one, and all empty texts are equal. A null id loses every tie. Rows that repeat id
    and code points of the row that stays are that row and are kept with it. Columns other than the two
    named are not read. No rows give no rows.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    return _decisions(docs, id_col, text_col).drop(*ROW_KEY)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows go one by one, not by id: where texts share an id, each stays or goes by itself, so every
    distinct text is left. Rows with a null id cannot be named and stay.
    """
    gone = _decisions(docs, id_col, text_col).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(*ROW_KEY).distinct()
    return without_rows(docs, gone, id_col, text_col)


def op2_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
