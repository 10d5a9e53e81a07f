"""Logs of runs: a header of ``# key=value`` lines, then frame,distance,speed[,flag] rows without names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmith.functions.text import SETTINGS, header_map, to_float, to_int, to_roi
from seriesmith.params import DEFAULTS

MARK = "\ufeff"  # of the byte order, a log's first character


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line and text of each line, the byte-order mark taken off.

    A file is read whole by one task, since its first lines say how to read the rest.
    """
    return _lines(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def _lines(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line", "text"))
    return lines.where(F.trim("text") != "")



def body_rows(lines: DataFrame) -> DataFrame:
    """Rows of the body: path, line, frame, dist, speed, flag. A row with fewer than 3 fields or one that is no number goes whole."""
    parts = F.split("text", ",")
    number = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    rows = lines.where(~F.col("text").startswith("#")).select(
        "path", "line", number(0).alias("frame"), number(1).alias("dist"), number(2).alias("speed"), F.coalesce(number(3), F.lit(0.0)).cast("int").alias("flag"), F.size(parts).alias("_n")
    )
    return rows.where((F.col("_n") >= 3) & F.col("frame").isNotNull() & F.col("dist").isNotNull() & F.col("speed").isNotNull()).drop("_n")


def headers(lines: DataFrame) -> DataFrame:
    """One map of settings per file, from the comment lines before the first row only."""
    first_row = F.min(F.when(~F.col("text").startswith("#"), F.col("line"))).over(Window.partitionBy("path"))
    leading = lines.withColumn("_f", first_row).where(F.col("text").startswith("#") & (F.col("_f").isNull() | (F.col("line") < F.col("_f"))))
    pairs = leading.select("path", "line", F.explode(header_map(F.regexp_replace("text", r"^#\s*", ""))).alias("key", "value"))
    last = pairs.groupBy("path", "key").agg(F.max_by("value", "line").alias("value"))
    return last.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))


def typed_settings(df: DataFrame, settings: str = "settings") -> DataFrame:
    """Adds a column per known header key, typed; a value that does not parse is null."""
    make = {"roi": to_roi, "int": to_int, "float": to_float, "str": lambda c: c}
    return df.withColumns({f"set_{k}": make[kind](F.element_at(settings, F.lit(k))) for k, kind in SETTINGS.items()})


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, t, dist, speed, flag per row of each log, times from the header's fps."""
    lines = read_lines(spark, path)
    fps = headers(lines).select("path", to_float(F.element_at("settings", F.lit("fps"))).alias("fps"))
    rows = body_rows(lines).join(fps, "path", "left")
    rate = F.when(F.coalesce("fps", F.lit(DEFAULTS.fps)) > 0, F.coalesce("fps", F.lit(DEFAULTS.fps))).otherwise(1.0)
    idx = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return rows.select("path", idx.alias("idx"), (F.col("frame") / rate).alias("t"), "dist", "speed", "flag")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, truth of a truth file: first and third field of each row; rows that do not parse go."""
    return body_rows(read_lines(spark, path)).select("path", F.col("frame").cast("int").alias("frame"), F.col("speed").alias("truth"))


def read_truths(spark: SparkSession, folder: str) -> DataFrame:
    """run, frame, truth of every run in a folder: from its ``_truth`` file, and only without one from its ``_ref`` file."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*_{truth,ref}.csv").select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.regexp_extract("path", r"([^/]+)_(truth|ref)\.csv$", 1)
    files = files.withColumn("run", name).withColumn("_ref", F.col("path").endswith("_ref.csv"))
    best = files.groupBy("run").agg(F.min("_ref").alias("_ref"))
    rows = body_rows(_lines(files.join(best, ["run", "_ref"]).select("path", "value")))
    return rows.select(name.alias("run"), F.col("frame").cast("int").alias("frame"), F.col("speed").alias("truth"))


def read_named(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """A CSV with names in its first row and comments; columns that a file lacks are null."""
    df = spark.read.csv(path, header=True, comment="#")
    return df.select(*[(F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in wanted])


def read_series_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Recorded series: one JSON document per run with an array of segments; over several lines, or one a line."""
    schema = "video string, version string, tol double, segments array<struct<rep:int,mid:int,len:int,raw:int,corr:int,truth:int>>"
    docs = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return docs.select(F.col("video").alias("run"), "version", "tol", F.posexplode("segments").alias("seg", "s")).select("run", "version", "tol", "seg", "s.*")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Index and character of a recogniser's dictionary: a blank first, the file's lines, a space last."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("l"))
    return lines.select(F.posexplode(F.concat(F.array(F.lit("blank")), "l", F.array(F.lit(" ")))).alias("idx", "ch"))


def _log_rows(log: DataFrame, settings: DataFrame) -> DataFrame:
    """run_id, part, ord and value: header lines (part 0) and rows of the body (part 1) of each log."""
    head = settings.select("run_id", F.posexplode("header").alias("a", "h")).select("run_id", F.lit(0).alias("part"), F.col("a").cast("long").alias("ord"), F.concat(F.lit("# "), "h").alias("value"))
    body = log.select(
        "run_id", F.lit(1).alias("part"), F.col("frame").cast("long").alias("ord"),
        F.format_string("%d,%.2f,%d,%d", F.col("frame").cast("long"), F.col("dist").cast("double"), F.coalesce(F.col("speed").cast("long"), F.lit(-1).cast("long")), F.col("flag").cast("long")).alias("value"),
    )
    return head.unionByName(body)


def write_logs(log: DataFrame, settings: DataFrame, path: str) -> None:
    """Write each run's log as text below path/run_id=...: header lines in fixed order, then rows.

    log: run_id, frame, dist, speed, flag. settings: run_id and header, an array of lines without '#'.
    A run is one file; runs are spread over tasks.
    """
    mark = F.when((F.col("part") == 0) & (F.col("ord") == 0), MARK).otherwise("")
    rows = _log_rows(log, settings).withColumn("value", F.concat(mark, "value")).repartition("run_id").sortWithinPartitions("run_id", "part", "ord")
    rows.select("run_id", "value").write.partitionBy("run_id").text(path)


def write_bundles(log: DataFrame, settings: DataFrame, path: str) -> None:
    """Write the logs of many runs to each text file below path, one after another, as a file a run costs more than its rows.

    As write_logs, but for a line ``# run_id=...`` before the others, which has the byte-order mark. It is where
    a log begins, so neither run_id nor a line of a header may hold a line break; a null run_id is empty.
    """
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("part", "ord")) == 1
    name = F.concat(F.lit(f"{MARK}# run_id="), F.coalesce(F.col("run_id").cast("string"), F.lit("")), F.lit("\n"))
    rows = _log_rows(log, settings).repartition("run_id").withColumn("_first", first).sortWithinPartitions("run_id", "part", "ord")
    rows.select(F.concat(F.when(F.col("_first"), name).otherwise(""), F.coalesce("value", F.lit(""))).alias("value")).write.text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """path, line and text of each line of bundled logs: the path of the bundle, followed by /run_id=... of the log.

    A log is read whole by one task, a bundle by several.
    """
    logs = spark.read.text(path, lineSep=f"\n{MARK}")
    name = F.regexp_extract("value", f"^{MARK}?# (run_id=[^\r\n]*)", 1)
    return _lines(logs.select(F.concat("_metadata.file_path", F.lit("/"), name).alias("path"), "value"))


def write_baseline(result: DataFrame, path: str, tolerance: float, version: str) -> None:
    """A graded result as JSON, one row per run and one for all, with the tolerance and version it holds for."""
    result.withColumn("tol", F.lit(float(tolerance))).withColumn("version", F.lit(version)).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str, tolerance: float, run_type: str = "long") -> DataFrame:
    """The rows of a baseline; raises ValueError if it holds for another tolerance."""
    schema = f"run_id {run_type}, seg long, raw long, fix long, fix_wrong long, missed long, harm long, final long, tol double, version string"
    df = spark.read.schema(schema).json(path)
    if df.where(F.col("tol") != tolerance).limit(1).count():
        raise ValueError(f"the baseline was made for another tolerance than {tolerance}")
    return df.drop("tol", "version")


def orphans(files: DataFrame, manifest: DataFrame, name: str = "file") -> DataFrame:
    """Files that the manifest does not name."""
    return files.join(manifest.select(name).distinct(), name, "left_anti")
