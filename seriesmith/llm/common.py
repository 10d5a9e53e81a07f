"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the text contracts: space and U+0009 to U+000D.
ASCII_SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Only on a local master, as in tests, is a temporary folder set where the session has none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor costs nothing.

    The table stays until ``discard``, or ``discard_all`` once no result that reads one is needed any more.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def discard(path: str) -> None:
    """Delete a materialised table; what is gone already is no error."""
    fs, place = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(place).type != pafs.FileType.NotFound:
        fs.delete_dir(place)
    if path in _written:
        _written.remove(path)


def discard_all() -> None:
    """Delete every table that ``materialize`` wrote in this process."""
    for path in list(_written):
        discard(path)


#: Names a row by its id, null or not, and 128 bits of its text; never null, so that equal keys are equal rows.
ROW_KEY = ["k_id", "k_a", "k_b"]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """The columns of ROW_KEY."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    named = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return [named.alias("k_id"), F.xxhash64(text).alias("k_a"), F.xxhash64(F.lit(1), text).alias("k_b")]


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name clashes with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def join_shuffled(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by shuffle of both sides at every size, for a right side that grows with the data."""
    return left.join(right.hint("merge"), keys, how)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose ROW_KEY is in ``gone``; any column names may occur in it."""
    return join_dealt(docs.select(whole_row(docs), *row_key(id_col, text_col)), gone.hint("merge"), ROW_KEY, "left_anti").select("row.*")


def strip_spaces(text: Column) -> Column:
    """Delete every ASCII white-space character; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in ASCII_SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def count_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose two sides are both shuffled anew.

    A side that has just been grouped by the keys would be joined where it lies, and adaptive
    execution then may not split the other side's large partitions. A key more makes both sides
    start from a shuffle of their own; a partition that a hot key makes large is then split by
    adaptive execution, which reads it by several tasks.
    """
    again = F.xxhash64(*keys)
    return left.withColumn("__dealt", again).join(right.withColumn("__dealt", again), ["__dealt", *keys], how).drop("__dealt")
