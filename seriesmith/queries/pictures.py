"""Pictures in arrays: embeddings as 8 x 8 pictures of 256 grays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmith.catalog import query
from seriesmith.operators import pixels
from seriesmith.plans.adapters import table

PX_SQL = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(least(greatest(floor((x::DOUBLE + 0.5) * 255), 0), 255) AS INTEGER)) AS px FROM embeddings)"


def _pictures(spark, sf_dir):
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", px.alias("px"))


def stored_frames(spark, sf_dir):
    """The pictures as rows of schemas.FRAMES: a run a label, frames in the order of the ids."""
    frame = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("frame")
    return _pictures(spark, sf_dir).select(F.col("label").cast("long").alias("run_id"), frame, F.lit(8).alias("h"), F.lit(8).alias("w"), "px")


def _text(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


@query("picture_sharpness", f"WITH {PX_SQL}, u AS (SELECT vec_id, unnest(px) AS x FROM v) SELECT vec_id, round(stddev_pop(x), 6) AS sharp FROM u GROUP BY vec_id")
def picture_sharpness(spark, sf_dir):
    return _pictures(spark, sf_dir).select("vec_id", F.round(pixels.sharpness(F.col("px")), 6).alias("sharp"))


@query(
    "otsu_thresholds",
    f"""WITH {PX_SQL}, u AS (SELECT label, unnest(px) AS bin FROM v), h AS (SELECT label, bin, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(n * bin) OVER w AS cm, sum(n) OVER t AS tn, sum(n * bin) OVER t AS tm FROM h WINDOW w AS (PARTITION BY label ORDER BY bin), t AS (PARTITION BY label)),
b AS (SELECT label, bin, CASE WHEN cn > 0 AND tn > cn THEN cn::DOUBLE * (tn - cn) * pow(cm::DOUBLE / cn - (tm - cm)::DOUBLE / (tn - cn), 2) END AS var FROM c)
SELECT label, coalesce(arg_max(bin, {{'v': round(var, 4), 'b': -bin}}) FILTER (var IS NOT NULL), 127) AS threshold FROM b GROUP BY label""",
)
def otsu_thresholds(spark, sf_dir):
    return pixels.otsu(_pictures(spark, sf_dir), ["label"])


@query(
    "calibration_otsu",
    f"""WITH {PX_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM v), u AS (SELECT label, vec_id, unnest(px) AS bin FROM f WHERE rn <= 50),
h AS (SELECT label, vec_id, bin, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(n * bin) OVER w AS cm, sum(n) OVER t AS tn, sum(n * bin) OVER t AS tm FROM h WINDOW w AS (PARTITION BY label, vec_id ORDER BY bin), t AS (PARTITION BY label, vec_id)),
b AS (SELECT label, vec_id, bin, CASE WHEN cn > 0 AND tn > cn THEN cn::DOUBLE * (tn - cn) * pow(cm::DOUBLE / cn - (tm - cm)::DOUBLE / (tn - cn), 2) END AS var FROM c),
o AS (SELECT label, vec_id, coalesce(arg_max(bin, {{'v': round(var, 4), 'b': -bin}}) FILTER (var IS NOT NULL), 127) AS threshold FROM b GROUP BY label, vec_id)
SELECT label, CAST(trunc(median(threshold)) AS INTEGER) AS threshold FROM o GROUP BY label""",
)
def calibration_otsu(spark, sf_dir):
    """The median of the first pictures' Otsu thresholds."""
    return pixels.calibration(_pictures(spark, sf_dir), "label", "vec_id")


@query(
    "change_masks",
    f"""WITH {PX_SQL}, p AS (SELECT *, lag(px) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM v)
SELECT vec_id, list_sum(list_transform(range(1, len(px) + 1), lambda i: CASE WHEN (px[i] > 127) <> (prev[i] > 127) THEN 1 ELSE 0 END)) AS n FROM p WHERE prev IS NOT NULL""",
)
def change_masks(spark, sf_dir):
    px = pixels.binarise(F.col("px"), F.lit(127))
    df = _pictures(spark, sf_dir).withColumn("b", px).withColumn("prev", F.lag("b").over(Window.partitionBy("label").orderBy("vec_id")))
    mask = pixels.changed(F.col("prev"), F.col("b"))
    return df.where("prev is not null").select("vec_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@query(
    "change_windows",
    f"""WITH {PX_SQL}, p AS (SELECT *, lag(px) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM v),
m AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(list_transform(range(1, 65), lambda i: CASE WHEN (px[i] > 127) <> (prev[i] > 127) THEN 1 ELSE 0 END)) AS d FROM p WHERE prev IS NOT NULL),
s AS (SELECT a.vec_id, a.k, sum(b.d) AS s FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.k // 8 - b.k // 8) <= 1 AND abs(a.k % 8 - b.k % 8) <= 1 GROUP BY ALL)
SELECT vec_id, CAST(max(s) AS INTEGER) AS change, max(s) >= 5 AS boundary FROM s GROUP BY vec_id""",
)
def change_windows(spark, sf_dir):
    df = _pictures(spark, sf_dir).withColumn("b", pixels.binarise(F.col("px"), F.lit(127))).withColumn("prev", F.lag("b").over(Window.partitionBy("label").orderBy("vec_id")))
    rows = df.where("prev is not null").select("vec_id", pixels.changed(F.col("prev"), F.col("b")).alias("mask"), F.lit(8).alias("w"))
    return pixels.window_sum_max(rows, "mask", "w").select("vec_id", "change", (F.col("change") >= 5).alias("boundary"))


@query(
    "whole_gray_and_gamma",
    f"""WITH {PX_SQL}, g AS (SELECT *, list_transform(px, lambda x: CAST(floor(255 * pow(x / 255.0, 2.0)) AS INTEGER)) AS gm FROM v)
SELECT vec_id, array_to_string(gm, ' ') AS gamma,
array_to_string(list_transform(px, lambda y: CAST(least(greatest(floor((y - 16) * 255 / 219.0 + 0.5), 0), 255) AS INTEGER)), ' ') AS full_range,
array_to_string(list_transform(range(1, len(px) + 1), lambda i: CAST(floor(px[i] * 0.299::DOUBLE + px[len(px) + 1 - i] * 0.587::DOUBLE + gm[i] * 0.114::DOUBLE) AS INTEGER)), ' ') AS gray FROM g""",
)
def whole_gray_and_gamma(spark, sf_dir):
    """Every pixel of a picture; its colour planes are the picture, the same from its end, and its gamma."""
    px, gm = F.col("px"), pixels.gamma(F.col("px"), 2.0)
    gray = pixels.gray(px, F.reverse(px), gm)
    return _pictures(spark, sf_dir).select("vec_id", _text(gm).alias("gamma"), _text(pixels.expand_range(px)).alias("full_range"), _text(gray).alias("gray"))


_LEVEL = "CAST(floor(least(greatest((px[i + 1] - 16) * 1.164383::DOUBLE + (px[41 + (i // 8 // 2) * 8 + (i % 8) // 2 * 2] - 128) * {0}::DOUBLE + (px[42 + (i // 8 // 2) * 8 + (i % 8) // 2 * 2] - 128) * {1}::DOUBLE, 0), 255)) AS INTEGER)"
_PLANE = "array_to_string(list_transform(range(0, 40), lambda i: " + _LEVEL + "), ' ')"


@query(
    "packed_colours",
    f"WITH {PX_SQL} SELECT vec_id, {_PLANE.format('0.0', '1.596027')} AS red, {_PLANE.format('(-0.391762)', '(-0.812968)')} AS green, {_PLANE.format('2.017232', '0.0')} AS blue FROM v",
)
def packed_colours(spark, sf_dir):
    """Pictures as packed ones of 8 x 5 pixels: five rows of luma, three of chroma."""
    rgb = _pictures(spark, sf_dir).select("vec_id", pixels.nv12_planes(F.col("px"), F.lit(8), F.lit(8)).alias("c"))
    return rgb.select("vec_id", *[_text(F.col(f"c.{n}")).alias(n) for n in ("red", "green", "blue")])


@query(
    "contrast_stretch",
    f"""WITH {PX_SQL},
b AS (SELECT vec_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM (SELECT vec_id, unnest(px)::DOUBLE AS x FROM v) GROUP BY vec_id)
SELECT v.vec_id, CAST(list_sum(list_transform(px, lambda x: floor(least(greatest((x - lo) * 255 / greatest(hi - lo, 1), 0), 255) + 1e-9))) AS BIGINT) AS total FROM v JOIN b USING (vec_id)""",
)
def contrast_stretch(spark, sf_dir):
    df = _pictures(spark, sf_dir)
    cuts = df.select("vec_id", F.explode("px").alias("x")).groupBy("vec_id").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    out = df.join(cuts, "vec_id").select("vec_id", pixels.stretch(F.col("px"), F.get("q", F.lit(0)), F.get("q", F.lit(1))).alias("s"))
    return out.select("vec_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    "histogram_equalised",
    f"""WITH {PX_SQL}, h AS (SELECT label, bin, count(*) AS n FROM (SELECT label, unnest(px) AS bin FROM v) GROUP BY ALL),
c AS (SELECT label, bin, sum(n) OVER (PARTITION BY label ORDER BY bin) AS cn, sum(n) OVER (PARTITION BY label) AS tn FROM h)
SELECT label, bin, CAST(floor(255.0 * cn / tn) AS INTEGER) AS value FROM c""",
)
def histogram_equalised(spark, sf_dir):
    h = _pictures(spark, sf_dir).select("label", F.explode("px").alias("bin")).groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label")
    return h.select("label", "bin", F.floor(255.0 * F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).cast("int").alias("value"))


_AT = "(({0}) / 2.0 - 0.25)"
_X, _Y = _AT.format("i % 16"), _AT.format("i // 16")
_SHARE = "(least(greatest({0}, 0), 7) - floor(least(greatest({0}, 0), 7)))"


def _corner(dy: int, dx: int) -> str:
    low = "CAST(least(floor(least(greatest({0}, 0), 7)) + {1}, 7) AS INTEGER)"
    return f"gm[{low.format(_Y, dy)} * 8 + {low.format(_X, dx)} + 1]"


_BILINEAR = " + ".join(f"{_corner(dy, dx)} * {_SHARE.format(_Y) if dy else '(1 - ' + _SHARE.format(_Y) + ')'} * {_SHARE.format(_X) if dx else '(1 - ' + _SHARE.format(_X) + ')'}" for dy in (0, 1) for dx in (0, 1))


@query(
    "prepared_pictures",
    f"""WITH {PX_SQL}, g AS (SELECT *, list_transform(px, lambda x: floor(255 * pow(x / 255.0, 2.0))) AS gm FROM v)
SELECT vec_id, 16 AS width, array_to_string(list_transform(range(0, 256), lambda i: CAST(round(16 * ({_BILINEAR})) AS INTEGER)), ' ') AS levels FROM g""",
)
def prepared_pictures(spark, sf_dir):
    """Gamma and a bilinear resize to twice the size; a level is a whole number of sixteenths."""
    frames = _pictures(spark, sf_dir).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), "px")
    return pixels.prepared(frames, 16).select("vec_id", "width", _text(F.transform("levels", lambda x: F.round(x.cast("double") * 16).cast("int"))).alias("levels"))
