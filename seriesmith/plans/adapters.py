"""The driver's tables as the relations that the series operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as runs of readings: one run a user, in order of time.

    The reading is the whole part of the value, null for errors; the time axis is in hours; a segment
    holds 1 to 4 frames. Truth is known for two readings in three and off by 3 for one in eleven.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = F.floor("value").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        (F.row_number().over(order) - 1).alias("seg"),
        F.expr("cast(timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts) as int)").alias("mid"),
        (F.col("event_id") % 4 + 1).cast("int").alias("len"),
        F.when(F.col("event_type") != "error", whole).alias("raw"),
        F.when(F.col("event_id") % 3 != 0, whole + F.when(F.col("event_id") % 11 == 0, 3).otherwise(0)).alias("truth"),
        "event_type",
        "event_id",
    )


#: The same in DuckDB.
READINGS_SQL = """
r AS (
  SELECT user_id AS run_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seg,
         CAST(floor(epoch(ts) / 3600) AS INTEGER) AS mid,
         CAST(event_id % 4 + 1 AS INTEGER) AS len,
         CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INTEGER) END AS raw,
         CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS INTEGER) + CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END END AS truth,
         event_type, event_id
  FROM events)"""
