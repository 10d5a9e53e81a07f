"""Stored pictures: PNG filters, pushdown by names, manifests, failed attempts."""

import os
import struct
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.sources import pictures


def folder():
    return "file://" + tempfile.mkdtemp(prefix="pictures-")


def made(spark, runs=3, frames=10, h=4, w=5):
    df = spark.range(runs * frames).select((F.col("id") % runs).alias("run_id"), F.floor(F.col("id") / runs).cast("int").alias("frame"), F.lit(h).alias("h"), F.lit(w).alias("w"))
    return df.withColumn("px", F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda k: ((k * 37 + F.col("frame") * 11 + F.col("run_id")) % 256).cast("int")))


def rows(df):
    return sorted((r["run_id"], r["frame"], r["h"], r["w"], tuple(r["px"])) for r in df.collect())


def png(px, kinds, colour=0, step=1):
    """A PNG whose lines take the given filters, by the definition of each, byte by byte."""
    h, w = px.shape[0], px.shape[1] * step
    flat, out = px.reshape(h, w).astype(int), []
    for y in range(h):
        kind = kinds[y % len(kinds)]
        line = [kind]
        for x in range(w):
            a = flat[y, x - step] if x >= step else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((flat[y, x] - [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(bytes(int(v) for v in line))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
def test_every_png_filter(kinds):
    px = np.random.default_rng(1).integers(0, 256, (7, 9)).astype(np.uint8)
    assert (pictures.png_gray(png(px, kinds)) == px).all()
    assert (pictures.png_gray(pictures.png_bytes(px)) == px).all()
    colours = np.random.default_rng(2).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    want = (colours.astype(float) @ [0.299, 0.587, 0.114]).astype(np.uint8)
    assert (pictures.png_gray(png(colours, kinds, 2, 3)) == want).all()


def test_damaged_png_is_refused():
    data = bytearray(pictures.png_bytes(np.zeros((3, 3), np.uint8)))
    data[-20] ^= 1
    with pytest.raises(ValueError):
        pictures.png_gray(bytes(data))


@pytest.mark.parametrize("kind", ["npy", "png"])
def test_written_and_read_again(spark, kind):
    df, path = made(spark), folder()
    pictures.write_pictures(df, path, kind)
    assert rows(pictures.read_pictures(spark, path)) == rows(df)
    pictures.write_pictures(df.withColumn("run_id", F.col("run_id") + 100), path, kind)  # a second write adds
    assert pictures.read_pictures(spark, path).count() == 60
    assert pictures.orphan_files(spark, path).count() == 0


def test_sizes_and_gaps_in_one_folder(spark):
    df, path = made(spark, 2, 5).where("frame <> 2").unionByName(made(spark, 1, 3, 2, 2).withColumn("run_id", F.lit(-7).cast("long"))), folder()
    pictures.write_pictures(df, path)
    assert rows(pictures.read_pictures(spark, path)) == rows(df)


def test_files_outside_a_range_are_not_opened(spark):
    df, path = made(spark, 4, 200), folder()
    pictures.write_pictures(df, path)
    names = pictures.committed(path)
    for name in names:  # what must not be read cannot be read
        run, first, last = (int(x) for x in pictures._NAME.search(name).groups()[:3])
        if run != 2 or last < 70 or first >= 75:
            with open(os.path.join(path.removeprefix("file://"), name), "wb") as f:
                f.write(b"nothing")
    got = pictures.read_pictures(spark, path).where("frame >= 70 and frame < 75 and run_id = 2")
    assert [r["frame"] for r in got.orderBy("frame").collect()] == list(range(70, 75))
    reader = pictures.PicturesReader({"path": path, "task_frames": "64"})
    whole = len(reader.files())
    list(reader.pushFilters([pictures.EqualTo(("run_id",), 2), pictures.LessThan(("frame",), 64)]))
    assert len(reader.files()) < whole / 4
    with pytest.raises(Exception, match="holds no pictures|magic|EOF|No data|pickle"):
        pictures.read_pictures(spark, path).where("run_id = 1").collect()


def test_a_failed_write_leaves_nothing_in_the_manifest(spark):
    path = folder()
    pictures.write_pictures(made(spark, 1, 5), path)
    broken = made(spark, 8, 50).withColumn("px", F.when((F.col("run_id") == 7) & (F.col("frame") == 49), F.array(F.lit(1))).otherwise(F.col("px")))
    with pytest.raises(Exception, match="is no picture"):
        pictures.write_pictures(broken, path)
    assert rows(pictures.read_pictures(spark, path)) == rows(made(spark, 1, 5))
    with open(os.path.join(path.removeprefix("file://"), "run9_0-0_ab.npy"), "wb") as f:
        f.write(b"left by a lost executor")
    assert "run9_0-0_ab.npy" in {r["name"] for r in pictures.orphan_files(spark, path).collect()}
    assert not any(n in set(pictures.committed(path)) for n in (r["name"] for r in pictures.orphan_files(spark, path).collect()))


def test_empty_folder_and_empty_write(spark):
    path = folder()
    assert pictures.read_pictures(spark, path).count() == 0
    pictures.write_pictures(made(spark).limit(0), path)
    assert pictures.read_pictures(spark, path).where("frame > 3").count() == 0


def test_crop_at_the_edges(spark):
    df = spark.createDataFrame([(1, 0, 3, 4, list(range(12)))], pictures.SCHEMA)
    box = lambda *b: [(r["h"], r["w"], r["px"]) for r in pictures.crop(df, *b).collect()]
    assert box(1, 1, 2, 2) == [(2, 2, [5, 6, 9, 10])]
    assert box(-1, 3, 3, 9) == [(2, 1, [3, 7])]
    assert box(0, 0, 3, 4) == [(3, 4, list(range(12)))]
    assert box(5, 0, 2, 2) == [] and box(0, 0, 0, 4) == []
