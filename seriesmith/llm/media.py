"""Media columns: Netpbm and BMP images as numpy arrays, resized by area, tiled and hashed.

Images stay in binary columns and every step is one Arrow batch function, so nothing is shuffled; media
and their tiles are stored as Parquet before they are read back.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import materialize, read_table

#: Bytes that a stored payload is a multiple of, and the byte that fills it up.
UNIT = 576
FILL = b"\xff"
#: Samples in one row of a stored payload; UNIT is a multiple of it.
WIDTH = 24
#: Samples whose integral image is held at a time.
STRIP = 1 << 20
#: Side of the tiles that a resized image is cut into, and tiles a side.
TILE = 8
TILES = 2

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array (height, width) or (height, width, 3); bits become 0 and 255.

    Samples of more than 8 bits keep their value as uint16.
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found:
            raise ValueError("the header ends early")
        head.append(int(found[1]))
        at = found.end()
    width, height = head[:2]
    most = head[2] if len(head) == 3 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[:n] - 48
        flat = ((1 - bits) * 255).astype(np.uint8)
    elif kind == b"P4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        flat = ((1 - np.unpackbits(packed, axis=1)[:, :width]) * 255).astype(np.uint8).ravel()
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], dtype=np.int64).astype(np.uint8 if most < 256 else np.uint16)
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(flat) != n:
        raise ValueError("the image ends early")
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 of an array (height, width), P6 of (height, width, 3), 8 bits a sample."""
    kind = "P6" if image.ndim == 3 else "P5"
    return f"{kind}\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits to an array (height, width, 3) in the order red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError("only uncompressed BMP is read")
    tall = abs(height)
    row = (width * depth + 31) // 32 * 4
    lines = np.frombuffer(data, np.uint8, row * tall, start).reshape(tall, row)
    if depth >= 24:
        out = lines[:, : width * depth // 8].reshape(tall, width, depth // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        per = 8 // depth
        index = np.stack([(lines >> (8 - depth * (k + 1))) & ((1 << depth) - 1) for k in range(per)], axis=2).reshape(tall, -1)[:, :width]
        out = palette[index]
    return out[::-1] if height > 0 else out


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of an array (height, width, 3)."""
    height, width = image.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    lines = np.zeros((height, row), np.uint8)
    lines[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + lines.size, 0, 0, 54, 40, width, height, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def gray(image: np.ndarray) -> np.ndarray:
    """Mean of the channels as float; one channel stays as it is."""
    return image.mean(axis=2) if image.ndim == 3 else image


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target pixel covers, fractions of pixels included.

    Sums come from integral images of strips of rows, so little more than the image is held.
    """
    rows, columns = image.shape
    y, x = np.linspace(0, rows, height + 1), np.linspace(0, columns, width + 1)
    low_x = np.minimum(x.astype(np.int64), columns - 1)
    part_x = x - low_x
    out = np.zeros((height, width))
    step = max(1, STRIP // columns)
    for top in range(0, rows, step):
        strip = image[top : top + step]
        table = np.zeros((len(strip) + 1, columns + 1))
        np.cumsum(np.cumsum(strip, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
        first, last = np.searchsorted(y, top, "right") - 1, np.searchsorted(y, top + len(strip), "left")
        edges = np.clip(y[first : last + 1] - top, 0, len(strip))
        low = np.minimum(edges.astype(np.int64), len(strip) - 1)
        part = (edges - low)[:, None]
        sums = table[low] * (1 - part) + table[low + 1] * part
        sums = sums[:, low_x] * (1 - part_x) + sums[:, low_x + 1] * part_x
        out[first:last] += np.diff(np.diff(sums, axis=0), axis=1)
    return out / ((rows / height) * (columns / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 x 9 area means is less than its right neighbour."""
    small = np.round(resize_area(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(image: np.ndarray, tile: int = TILE, tiles: int = TILES) -> list[bytes]:
    """The area-resized image cut into tiles x tiles arrays of uint8, each as an NPY file, row by row."""
    small = np.clip(np.round(resize_area(image, tile * tiles, tile * tiles), 6) + 0.5, 0, 255).astype(np.uint8)
    out = []
    for i in range(tiles):
        for j in range(tiles):
            sink = io.BytesIO()
            np.lib.format.write_array(sink, np.ascontiguousarray(small[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]), version=(1, 0))
            out.append(sink.getvalue())
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled up to a multiple of UNIT, as P5 samples.

    Null and empty texts are one UNIT of FILL. Ids pass through; other columns are not read.
    """
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    n = F.octet_length(data)
    size = F.greatest(F.lit(1), F.ceil(n / UNIT)) * UNIT
    head = F.format_string(f"P5\n{WIDTH} %d\n255\n", (size / WIDTH).cast("long")).cast("binary")
    fill = F.unhex(F.repeat(F.lit(FILL.hex()), (size - n).cast("int")))
    return docs.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("n_bytes"), F.concat(head, data, fill).alias("media"))


def image_features(images: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds to each row what its image gives: samples (bytes in order), dhash, tiles (NPY files).

    A null, empty or unreadable image gives nulls.
    """

    def one(data: bytes | None):
        try:
            image = decode_image(data or b"")
        except (ValueError, struct.error, IndexError):
            return None, None, None
        flat = gray(image)
        return image.tobytes(), difference_hash(flat), npy_tiles(flat)

    names = [c for c in images.columns if c not in ("samples", "dhash", "tiles")]
    at = names.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                samples, hashes, tiles = zip(*map(one, part.column(at).to_pylist()))
                new = [pa.array(samples, pa.binary()), pa.array(hashes, pa.string()), pa.array(tiles, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, "samples", "dhash", "tiles"])

    schema = images.select(names).schema.add("samples", "binary").add("dhash", "string").add("tiles", T.ArrayType(T.BinaryType()))
    return images.select(names).mapInArrow(run, schema)


def with_tiles(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and tiles: the NPY tiles of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = [npy_tiles(gray(decode_image(data.as_buffer().to_pybytes()))) for data in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "tiles"])

    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("tiles", T.ArrayType(T.BinaryType()))]))


def image_digests(media: DataFrame) -> DataFrame:
    """What each stored image holds, as digests: read back a few rows at a time, nothing large is kept.

    Tiles are those of the table if it has them.
    """
    stored = "tiles" in media.columns

    def one(data: bytes, kept: list[bytes] | None) -> tuple:
        image = decode_image(data)
        samples, flat = image.tobytes(), gray(image)
        tiles = b"".join(kept if stored else npy_tiles(flat))
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(flat)}:{zlib.crc32(tiles):08x}"

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch.column(3) if stored else [None] * batch.num_rows
            found = [one(data.as_buffer().to_pybytes(), kept.as_py() if stored else None) for data, kept in zip(batch.column(2), tiles)]
            columns = zip(*found) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", *names])

    id_type = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media", *(["tiles"] if stored else [])).mapInArrow(run, schema)


def op8_media(spark, sf_dir) -> DataFrame:
    return image_digests(materialize(with_tiles(store_texts(read_table(spark, sf_dir, "documents"))), "media"))
