"""Event-time windows over events; the same functions for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Event time as a timestamp with a watermark; without a zone it cannot carry one."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if events.isStreaming else out


def tumbling(events: DataFrame, width: str, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of each window."""
    out = timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "2 hours") -> DataFrame:
    out = timed(events, late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    """user_id, n and start of each session, a time without a gap as long as ``gap``."""
    out = timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", "n", F.col("w.start").cast("timestamp_ntz").alias("start"))


def followed_by(events: DataFrame, first: str, then: str, within: str, late: str = "2 hours") -> DataFrame:
    """Every event of type ``first`` with each of type ``then`` that the same user has within a time after it.

    user_id, first_id, then_id and wait_us, the time between in microseconds. Of a stream both sides carry a watermark, and the bounds
    on the times say for how long either has to be held in state.
    """
    rows = timed(events, late)
    a = rows.where(F.col("event_type") == first).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = rows.where(F.col("event_type") == then).select(F.col("user_id").alias("user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    soon = (F.col("user") == F.col("user_id")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, soon).select("user_id", "first_id", "then_id", (F.unix_micros("then_ts") - F.unix_micros("first_ts")).alias("wait_us"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have dropped as later than the watermark, over the progress it still has."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
