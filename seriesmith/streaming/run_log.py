"""An append-only log of what a stream yields: every batch once, though it is tried again."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

_ADDED = [StructField("app", StringType()), StructField("batch", LongType())]


def _commits(path: str) -> dict[tuple[str, int], str]:
    fs, base = pafs.FileSystem.from_uri(path)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/_commits", allow_not_found=True)):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with fs.open_input_stream(info.path, compression=None) as source:
                entry = json.loads(source.read())
            out[entry["app"], entry["batch"]] = entry["data"]
    return out


def append_once(batch: DataFrame, batch_id: int, path: str, app: str) -> bool:
    """Add a batch to the log unless (app, batch_id) is in it already; False if it is.

    The rows are written to a folder of their own, and are part of the log only once the transaction's
    file is moved into place; an attempt that breaks off before leaves nothing that is read.
    """
    fs, base = pafs.FileSystem.from_uri(path)
    shown = f"{base}/_commits/{app}-{batch_id}.json"
    if fs.get_file_info(shown).type != pafs.FileType.NotFound:
        return False
    data = f"data/{app}-{batch_id}-{uuid.uuid4().hex}"
    batch.write.parquet(f"{path}/{data}")
    fs.create_dir(f"{base}/_commits", recursive=True)
    hidden = f"{base}/_commits/.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden, compression=None) as out:
        out.write(json.dumps({"app": app, "batch": batch_id, "data": data}).encode())
    fs.move(hidden, shown)
    return True


def write_log(stream: DataFrame, path: str, app: str, checkpoint: str) -> StreamingQuery:
    """Start a query that adds every batch of ``stream`` to the log. ``app`` names the query for good, as its checkpoint does."""
    if not app.replace("_", "").isalnum():
        raise ValueError("an app is named by letters, digits and underscores")
    add = lambda batch, k: append_once(batch, k, path, app)
    return stream.writeStream.queryName(app).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches, with app and batch."""
    found = _commits(path)
    if not found:
        return spark.createDataFrame([], StructType([*schema.fields, *_ADDED]))
    rows = spark.read.schema(schema).parquet(*[f"{path}/{data}" for data in found.values()]).withColumn("_of", F.col("_metadata.file_path"))
    name = r"/data/(\w+)-(-?\d+)-"
    return rows.withColumn("app", F.regexp_extract("_of", name, 1)).withColumn("batch", F.regexp_extract("_of", name, 2).cast("long")).drop("_of")
