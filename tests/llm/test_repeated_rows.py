"""Rows that repeat as a whole, and what workers hold between jobs."""

from pyspark.sql import functions as F

from seriesmith.llm import exact_dedup
from seriesmith.llm.unit_cache import newest_per_worker


def test_text_that_stays_is_copied_once_a_salt(spark, monkeypatch):
    """Many rows that repeat the one that stays: the comparison has a row for each, not for each pair."""
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 10)
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = exact_dedup.exact_dedup(rows).groupBy("keep_id", "group_size", "kept").count().collect()
    assert [tuple(r) for r in got] == [(7, 3000, True, 3000)]


def test_a_worker_holds_the_newest_only():
    made = []
    for name in ("a", "a", "b", "b", "a"):
        newest_per_worker("test", name, lambda: made.append(1) or object())
    assert len(made) == 3
