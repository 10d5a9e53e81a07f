"""Small pictures in array columns: pixel arithmetic, thresholds, change masks.

Arrays are row-major lists of integers 0..255. What works pixel by pixel is a higher-order function;
neighbourhoods and colour planes are Arrow batch functions with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.params import DEFAULTS


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of three channel arrays, cut off to whole numbers."""
    rg = F.zip_with(r, g, lambda x, y: x * F.lit(0.299) + y * F.lit(0.587))
    return F.zip_with(rg, b, lambda x, y: F.floor(x + y * F.lit(0.114)).cast("int"))


def luma_plane(packed: Column, rows: Column, width: Column) -> Column:
    """The first two thirds of the rows of a packed picture with chroma below."""
    return F.slice(packed, 1, (F.floor(rows * 2 / 3) * width).cast("int"))


def expand_range(px: Column) -> Column:
    """Limited luma 16..235 to 0..255."""
    return F.transform(px, lambda y: F.least(F.greatest(F.floor((y - 16) * 255 / F.lit(219.0) + 0.5), F.lit(0)), F.lit(255)).cast("int"))


def gamma(px: Column, g: float) -> Column:
    return px if g <= 0 else F.transform(px, lambda x: F.floor(F.lit(255.0) * F.pow(x / F.lit(255.0), F.lit(g))).cast("int"))


def binarise(px: Column, threshold: Column) -> Column:
    return F.transform(px, lambda x: x > threshold)


def changed(a: Column, b: Column) -> Column:
    """Mask of pixels that differ; a missing picture, or one of another size, gives null."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (x != y).cast("int")))


def sharpness(px: Column) -> Column:
    """Population standard deviation of the pixels; null for no pixels."""
    n = F.size(px)
    total = F.aggregate(px, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    square = F.aggregate(px, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 0, F.sqrt(square / n))


def otsu(df: DataFrame, key: list[str], px: str = "px", fallback: int = DEFAULTS.otsu_fallback) -> DataFrame:
    """Threshold per key by the greatest variance between the classes; the first of equal ones.

    Pixels are counted into 256 bins, so what is shuffled does not grow with the pictures.
    """
    counts = df.select(*key, F.explode(px).alias("bin")).groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*key).agg(F.collect_list(F.struct("bin", "n")).alias("h")).select(*key, _otsu_of(F.sort_array("h"), fallback).alias("threshold"))


def calibration(df: DataFrame, group: str, order: str, frames: int = 50, spread: bool = False) -> DataFrame:
    """Threshold per group: the whole part of the median of each picture's own threshold, over ``frames`` pictures.

    These are the first ones, or if ``spread`` those at an even step over the whole group.
    """
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(group)) / frames)) if spread else F.lit(1)
    rows = df.select(group, order, "px", rn.alias("_rn"), step.alias("_step"))
    sample = rows.where((F.col("_rn") % F.col("_step") == 0) & (F.col("_rn") < F.col("_step") * frames))
    return otsu(sample, [group, order]).groupBy(group).agg(F.percentile("threshold", F.lit(0.5)).cast("int").alias("threshold"))


def _otsu_of(h: Column, fallback: int) -> Column:
    total = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    mass = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x["bin"] * x["n"])
    start = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.lit(-1.0).alias("best"), F.lit(None).cast("int").alias("at")
    )

    def step(acc, x):
        n, m = acc["n"] + x["n"], acc["m"] + x["bin"] * x["n"]
        rest = total - n
        apart = F.when((n > 0) & (rest > 0), n * F.lit(1.0) * rest * F.pow(m / n - (mass - m) / rest, 2))
        better = F.coalesce(apart > acc["best"], F.lit(False))
        return F.struct(
            n.alias("n"), m.alias("m"), F.when(better, apart).otherwise(acc["best"]).alias("best"), F.when(better, x["bin"].cast("int")).otherwise(acc["at"]).alias("at")
        )

    return F.coalesce(F.aggregate(h, start, step)["at"], F.lit(fallback))


def stretch(px: Column, low: Column, high: Column) -> Column:
    """Linear stretch of low..high to 0..255, cut off to whole numbers."""
    span = F.greatest(high - low, F.lit(1.0))
    return F.transform(px, lambda x: F.floor(F.least(F.greatest((x - low) * 255.0 / span, F.lit(0.0)), F.lit(255.0)) + 1e-9).cast("int"))


def window_sum_max(df: DataFrame, mask: str, width: str, name: str = "change") -> DataFrame:
    """Adds the greatest sum of a mask over 3 x 3 neighbours, zeros beyond the edges; null for a null mask."""

    def one(values, w):
        if values is None:
            return None
        m = np.asarray(values, np.int32).reshape(-1, w)
        if not m.any():
            return 0
        q = np.pad(m, 1)
        rows = q[:-2] + q[1:-1] + q[2:]
        return int((rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]).max())

    names = [c for c in df.columns if c != name]
    a, b = names.index(mask), names.index(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(v, w) for v, w in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*names, name])

    rows = df.select(names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())]))


#: Fixed weights of luma and of the two chroma planes for red, green and blue, limited range; 16 and 128 are black and no colour.
LUMA, RED_V, GREEN_U, GREEN_V, BLUE_U = 1.164383, 1.596027, -0.391762, -0.812968, 2.017232


def nv12_to_rgb(packed: np.ndarray, height: int, width: int) -> np.ndarray:
    """Picture (height, width, 3) from luma rows and interleaved chroma at half size, limited range; what chroma lacks at odd edges is 128."""
    luma = packed[:height, :width].astype(np.float64) - 16
    chroma = packed[height : height + (height + 1) // 2, : width // 2 * 2].astype(np.float64) - 128
    small = np.zeros(((height + 1) // 2, (width + 1) // 2, 2))
    small[: chroma.shape[0], : width // 2] = chroma.reshape(chroma.shape[0], width // 2, 2)
    full = small.repeat(2, axis=0).repeat(2, axis=1)[:height, :width]
    u, v = full[:, :, 0], full[:, :, 1]
    rgb = np.stack([LUMA * luma + RED_V * v, LUMA * luma + GREEN_U * u + GREEN_V * v, LUMA * luma + BLUE_U * u], axis=2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def nv12_planes(packed: Column, rows: Column, width: Column) -> Column:
    """The same for a packed picture in an array of ``rows`` rows, two thirds of them luma: struct of red, green, blue arrays."""
    height = F.floor(rows * 2 / 3).cast("int")
    pixels = F.sequence(F.lit(0), height * width - 1)

    def chroma(i: Column, plane: int) -> Column:
        row, column = F.floor(F.floor(i / width) / 2), F.floor((i % width) / 2)
        at = (height * width + row * width + column * 2 + plane).cast("int")
        return F.when(column * 2 + 1 < width, F.coalesce(F.get(packed, at), F.lit(128))).otherwise(128) - 128.0

    def level(value: Column) -> Column:
        return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")

    def plane(of_u: float, of_v: float) -> Column:
        return F.transform(pixels, lambda i: level((F.get(packed, i) - 16) * F.lit(LUMA) + chroma(i, 0) * F.lit(of_u) + chroma(i, 1) * F.lit(of_v)))

    return F.struct(plane(0.0, RED_V).alias("red"), plane(GREEN_U, GREEN_V).alias("green"), plane(BLUE_U, 0.0).alias("blue"))


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with pixel centres aligned; the same size is returned as it is."""
    if image.shape[:2] == (height, width):
        return image

    def axis(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    f = image.astype(np.float32)
    wide = (slice(None), None, *[None] * (image.ndim - 2))
    top = f[y0][:, x0] + (f[y0][:, x1] - f[y0][:, x0]) * fx[(None, slice(None), *[None] * (image.ndim - 2))]
    low = f[y1][:, x0] + (f[y1][:, x1] - f[y1][:, x0]) * fx[(None, slice(None), *[None] * (image.ndim - 2))]
    return top + (low - top) * fy[wide]


def recogniser_input(image: np.ndarray, aspect: float | None = None, height: int = 48, pad_to: int = 0) -> np.ndarray:
    """Height-normalised, scaled to -1..1 and padded with zeros on the right: (1, height, width)."""
    width = round(height * aspect) if aspect else max(1, int(image.shape[1] * height / image.shape[0]))
    x = (resize_bilinear(image, height, width) / 255.0 - 0.5) / 0.5
    out = np.zeros((1, height, max(pad_to, width)), np.float32)
    out[0, :, :width] = x if x.ndim == 2 else x.mean(axis=2)
    return out


def prepared(frames: DataFrame, height: int = 48, power: float = 2.0, tolerance: float = 0.02) -> DataFrame:
    """Adds width and levels: pictures as a recogniser takes them, before they are scaled to -1..1.

    Grays go through the gamma ``power``, then pictures are brought to ``height`` keeping their shape,
    bilinear; one that has its size within the tolerance stays as it is. levels has ``height`` rows (of a
    picture that stays, its own) of ``width`` values each. Pictures of one size in a batch are resized
    together. A picture without pixels gives null.
    """
    names = [c for c in frames.columns if c not in ("width", "levels")]
    at = [names.index(c) for c in ("h", "w", "px")]
    curve = np.floor(255.0 * (np.arange(256) / 255.0) ** power).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, widths = (batch.column(k).to_pylist() for k in at[:2])
            column, n = batch.column(at[2]), batch.num_rows
            sizes: dict = {}
            for k, size in enumerate(zip(heights, widths)):
                if column[k].is_valid and None not in size and size[0] * size[1]:
                    sizes.setdefault(size, []).append(k)
            width, levels = [None] * n, [None] * n
            for (h, w), rows in sizes.items():
                stack = curve[np.stack([column[k].values.to_numpy(zero_copy_only=False) for k in rows])].reshape(len(rows), h, w)
                wide = max(1, w * height // h)
                if not (wide == w and abs(height - h) <= tolerance * height):
                    stack = np.moveaxis(resize_bilinear(np.moveaxis(stack, 0, 2), height, wide), 2, 0)
                for k, picture in zip(rows, stack):
                    width[k], levels[k] = picture.shape[1], picture.ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width, pa.int32()), pa.array(levels, pa.list_(pa.float32()))], [*names, "width", "levels"])

    rows = frames.select(names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("levels", T.ArrayType(T.FloatType()))]))


def scaled(levels: Column, width: Column, pad_to: Column) -> Column:
    """levels on the scale -1..1, each row of ``width`` values padded with zeros on the right."""
    rows = F.sequence(F.lit(0), (F.size(levels) / width).cast("int") - 1)
    zeros = F.array_repeat(F.lit(0.0), F.greatest(pad_to - width, F.lit(0)))
    one = lambda y: F.concat(F.transform(F.slice(levels, y * width + 1, width), lambda x: (x.cast("double") / 255.0 - 0.5) / 0.5), zeros)
    return F.when(width > 0, F.flatten(F.transform(rows, one)))


def component_share(mask: np.ndarray, least: int = 4) -> tuple[int, float]:
    """Size of the largest 8-connected component of a mask, and the share of its pixels in components of ``least`` or more."""
    m = np.pad(np.asarray(mask, bool), 1)
    label = np.where(m, np.arange(m.size).reshape(m.shape), -1)
    while True:
        best = label.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                best = np.maximum(best, np.roll(np.roll(label, dy, 0), dx, 1))
        best = np.where(m, best, -1)
        if np.array_equal(best, label):
            break
        label = best
    sizes = np.unique(label[m], return_counts=True)[1]
    return (int(sizes.max()), float(sizes[sizes >= least].sum() / sizes.sum())) if len(sizes) else (0, 0.0)


def component_shares(df: DataFrame, mask: str, width: str, least: int = 4) -> DataFrame:
    """Adds biggest and clustered: what ``component_share`` gives for a mask; null for a null mask."""
    names = [c for c in df.columns if c not in ("biggest", "clustered")]
    a, b = names.index(mask), names.index(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, None) if v is None else component_share(np.asarray(v, bool).reshape(-1, w), least) for v, w in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            biggest, clustered = (pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, biggest, clustered], [*names, "biggest", "clustered"])

    rows = df.select(names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("biggest", T.IntegerType()), T.StructField("clustered", T.DoubleType())]))


def input_width(width: Column, height: Column, target: int = 48, aspect: float = 0.0) -> Column:
    """Width of a picture brought to the target height, or of the given aspect; at least one pixel."""
    if aspect > 0:
        return F.greatest(F.lit(1), F.lit(round(target * aspect)))
    return F.when(height > 0, F.greatest(F.lit(1), F.floor(width * target / height).cast("int"))).otherwise(width)


def keeps_size(width: Column, height: Column, target: int = 48, aspect: float = 0.0, tolerance: float = 0.02) -> Column:
    """Whether a picture stays as it is: its width is right, its height within the tolerance."""
    return (input_width(width, height, target, aspect) == width) & (F.abs(F.lit(target) - height) <= F.lit(tolerance * target))


def padded_aspect(width: Column, height: Column, floor: Column, target: int = 48) -> Column:
    """Aspect that all pictures of a group are padded to (an aggregate): the widest one, at least the floor's width."""
    return F.greatest(F.max(floor) / F.lit(float(target)), F.max(width / height))
