"""Stored pictures as a table: ``spark.read.format("pictures")`` and ``df.write.format("pictures")``.

A folder holds gray pictures as NPY stacks (several successive frames of a run in one file) or as PNG
files (one frame each), named by run and frames. A write adds files, and a manifest of them when
it is committed; what an attempt wrote that failed is in no manifest and is never read. Ranges of
frames and runs in a filter choose files by their names, before any is opened; of a stack only the
frames that are asked for are given.

Rows: run_id, frame, h, w, px (h * w grays, row by row), as ``schemas.FRAMES``.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

SCHEMA = "run_id long, frame int, h int, w int, px array<int>"
#: Frames of one NPY stack, and of one task that reads.
STACK_FRAMES = 64
TASK_FRAMES = 1024
_NAME = re.compile(r"run(-?\d+)_(\d+)-(\d+)_[0-9a-f]+\.(npy|png)$")
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour types of PNG with the samples a pixel has; palettes are not gray.
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def png_bytes(px: np.ndarray) -> bytes:
    """An 8-bit gray picture as PNG, each line as its difference from the line above."""
    h, w = px.shape
    lines = np.diff(np.vstack([np.zeros((1, w), np.uint8), px]), axis=0)
    raw = np.hstack([np.full((h, 1), 2, np.uint8), lines]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one nearest to left + up - corner, in this order where two are as near."""
    aim = left + up - corner
    a, b, c = np.abs(aim - left), np.abs(aim - up), np.abs(aim - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _line(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of samples without its filter; step: bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 1:  # from the left: running sums of each sample
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"a PNG line has the filter {kind}")
    out = np.zeros(len(line), np.int64)
    up, zero = above.astype(np.int64), np.zeros(step, np.int64)
    for k in range(0, len(line), step):  # each pixel needs the one before
        here = slice(k, k + step)
        left = out[k - step : k] if k else zero
        guess = (left + up[here]) // 2 if kind == 3 else _nearest(left, up[here], up[k - step : k] if k else zero)
        out[here] = (line[here] + guess) & 255
    return out.astype(np.uint8)


def png_gray(data: bytes) -> np.ndarray:
    """The grays of an 8-bit PNG that is not interlaced; of coloured ones the luma, without alpha."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in _SAMPLES:
        raise ValueError("only 8-bit gray or true-colour PNG files that are not interlaced are read")
    step = _SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out, above = np.empty((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for k in range(h):
        out[k] = above = _line(int(rows[k, 0]), rows[k, 1:], above, step)
    px = out.reshape(h, w, step)
    if step < 3:
        return px[:, :, 0]
    return (px[:, :, :3].astype(float) @ [0.299, 0.587, 0.114]).astype(np.uint8)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int, int]]):
        self.files = files


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class PicturesReader(DataSourceReader):
    """Options: path; task_frames, frames that a task reads."""

    def __init__(self, options):
        self.path = options["path"]
        self.per_task = int(options.get("task_frames", TASK_FRAMES))
        self.low = {"frame": 0, "run_id": -(2**63)}
        self.high = {"frame": 2**31, "run_id": 2**63}  # not included

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.low or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, GreaterThanOrEqual):
                self.low[name] = max(self.low[name], f.value)
            elif isinstance(f, GreaterThan):
                self.low[name] = max(self.low[name], f.value + 1)
            elif isinstance(f, LessThan):
                self.high[name] = min(self.high[name], f.value)
            elif isinstance(f, LessThanOrEqual):
                self.high[name] = min(self.high[name], f.value + 1)
            elif isinstance(f, EqualTo):
                self.low[name], self.high[name] = max(self.low[name], f.value), min(self.high[name], f.value + 1)
            else:
                yield f

    def files(self) -> list[tuple[str, int, int, int]]:
        """Path, run, first and last frame of the committed files that the filters leave; names only."""
        out = []
        for name in committed(self.path):
            if found := _NAME.search(name):
                run, first, last = (int(found[k]) for k in (1, 2, 3))
                if self.low["run_id"] <= run < self.high["run_id"] and first < self.high["frame"] and last >= self.low["frame"]:
                    out.append((name, run, first, last))
        return sorted(out, key=lambda x: x[1:])

    def partitions(self):
        out, some, n = [], [], 0
        for file in self.files():
            some.append(file)
            n += file[3] - file[2] + 1
            if n >= self.per_task:
                out.append(_Files(some))
                some, n = [], 0
        return [*out, _Files(some)] if some or not out else out

    def read(self, partition):
        fs, base = pafs.FileSystem.from_uri(self.path)
        for name, run, first, last in partition.files:
            with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                data = source.read()
            stack = png_gray(data)[None] if name.endswith(".png") else np.load(io.BytesIO(data), allow_pickle=False)
            if stack.dtype != np.uint8 or stack.ndim != 3 or len(stack) != last - first + 1:
                raise ValueError(f"{name} holds no pictures of its frames")
            a, b = max(first, self.low["frame"]), min(last + 1, self.high["frame"])
            n, h, w = b - a, *stack.shape[1:]
            px = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h * w, pa.int32()), pa.array(stack[a - first : b - first].ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([run] * n, pa.int64()), pa.array(np.arange(a, b), pa.int32()), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), px], ["run_id", "frame", "h", "w", "px"])


class PicturesWriter(DataSourceArrowWriter):
    """Options: path; kind, npy or png. Successive frames of one run and size that come in order share a stack."""

    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "npy")
        if self.kind not in ("npy", "png"):
            raise ValueError(f"pictures are written as npy or png, not {self.kind}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        done, held, key = [], [], None
        most = STACK_FRAMES if self.kind == "npy" else 1

        def flush():
            run, last, _ = key
            name = f"run{run}_{last - len(held) + 1}-{last}_{uuid.uuid4().hex}.{self.kind}"
            if self.kind == "png":
                data = png_bytes(held[0])
            else:
                np.save(sink := io.BytesIO(), np.stack(held))
                data = sink.getvalue()
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            done.append(name)
            held.clear()

        for batch in iterator:
            for run, frame, h, w, px in zip(*(batch.column(n) for n in ("run_id", "frame", "h", "w", "px"))):
                run, frame, shape = run.as_py(), frame.as_py(), (h.as_py(), w.as_py())
                picture = px.values.to_numpy(zero_copy_only=False)
                if picture.size != shape[0] * shape[1] or (picture.size and (picture.min() < 0 or picture.max() > 255)):
                    raise ValueError(f"frame {frame} of run {run} is no picture of {shape[0]} x {shape[1]} grays")
                if held and (key != (run, frame - 1, shape) or len(held) == most):
                    flush()
                held.append(picture.astype(np.uint8).reshape(shape))
                key = (run, frame, shape)
        if held:
            flush()
        return _Written(done)

    def commit(self, messages):
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{base}/_manifest", recursive=True)
        hidden, shown = f"{base}/_manifest/.{(name := uuid.uuid4().hex)}", f"{base}/_manifest/{name}.json"
        with fs.open_output_stream(hidden, compression=None) as out:
            out.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        fs.move(hidden, shown)  # all of a write appears at once

    def abort(self, messages):
        """Files of tasks that ended; those of one that broke off are left as orphans."""
        fs, base = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                fs.delete_file(f"{base}/{name}")


def committed(path: str) -> list[str]:
    """Names of the files in the manifests below ``path``."""
    fs, base = pafs.FileSystem.from_uri(path)
    out: list[str] = []
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/_manifest", allow_not_found=True)):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with fs.open_input_stream(info.path, compression=None) as source:
                out += json.loads(source.read())
    return out


class PicturesSource(DataSource):
    @classmethod
    def name(cls):
        return "pictures"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PicturesReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("pictures are only added; take a new path")
        return PicturesWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PicturesSource)
    # filters are offered to Python sources only if this is set
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pictures(frames: DataFrame, path: str, kind: str = "npy") -> None:
    """Add pictures to a folder: runs and ranges of frames are spread over tasks, each in order."""
    register(frames.sparkSession)
    dealt = frames.select("run_id", "frame", "h", "w", "px").repartitionByRange("run_id", "frame").sortWithinPartitions("run_id", "frame")
    dealt.write.format("pictures").option("path", path).option("kind", kind).mode("append").save()


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("pictures").option("path", path).load()


def split_frames(frames: list[int], calibration: int, share: float) -> tuple[list[int], list[int]]:
    """Frames after the calibration, cut in order at ``share`` of all: the first reader's part and the second's."""
    cut = max(calibration, int(len(frames) * share))
    return frames[calibration:cut], frames[cut:]


def orphan_files(spark: SparkSession, path: str) -> DataFrame:
    """name of each picture file below ``path`` that no manifest names: left by attempts that failed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{npy,png}").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    listed = spark.read.option("pathGlobFilter", "*.json").text(f"{path}/_manifest", wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("name"))
    return files.join(listed, "name", "left_anti")


def crop(frames: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The same box of every picture; a part of the box outside a picture is left out, and so is a picture with no part in it."""
    y0, x0 = F.greatest(F.lit(top), F.lit(0)), F.greatest(F.lit(left), F.lit(0))
    y1, x1 = F.least(F.lit(top + height), F.col("h")), F.least(F.lit(left + width), F.col("w"))
    rows = F.transform(F.sequence(y0, y1 - 1), lambda y: F.slice("px", y * F.col("w") + x0 + 1, x1 - x0))
    inside = frames.where((y1 > y0) & (x1 > x0)).withColumn("_px", F.flatten(rows))  # before h and w take their new values
    return inside.select("run_id", "frame", (y1 - y0).cast("int").alias("h"), (x1 - x0).cast("int").alias("w"), F.col("_px").alias("px"))
