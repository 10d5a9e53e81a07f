"""Other forms of detection and scoring, shares of change masks, sizes of pictures, the table of runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmith.catalog import query
from seriesmith.operators import pixels, series, variants
from seriesmith.params import DEFAULTS
from seriesmith.plans.adapters import READINGS_SQL, readings, table
from seriesmith.queries.pictures import PX_SQL, _pictures
from seriesmith.queries.scoring import CONFIDENCE_SQL, DETECT_SQL

_PAIRS_SQL = f"""{DETECT_SQL},
p AS (
  SELECT m.run_id, m.seg, median(a.raw + (b.raw - a.raw)::DOUBLE * (m.mid - a.mid) / (b.mid - a.mid)) AS expected
  FROM b1 m JOIN r a ON a.run_id = m.run_id AND a.seg < m.seg AND a.raw IS NOT NULL AND m.mid - a.mid <= m.half
            JOIN r b ON b.run_id = m.run_id AND b.seg > m.seg AND b.raw IS NOT NULL AND b.mid - m.mid <= m.half
  WHERE b.mid - a.mid >= 1e-3 GROUP BY m.run_id, m.seg),
e AS (SELECT d.*, expected, greatest(abs(raw - lag(raw) OVER w), abs(raw - lead(raw) OVER w)) AS step FROM d LEFT JOIN p USING (run_id, seg) WINDOW w AS (PARTITION BY run_id ORDER BY seg))"""


def _expected(spark, sf_dir):
    return variants.pair_expectation(series.local_bandwidth(readings(spark, sf_dir)))


@query(
    "detect_by_pairs",
    f"""WITH {_PAIRS_SQL}, f AS (SELECT *, raw IS NULL OR expected IS NULL OR abs(raw - expected) > greatest(bw, 3.0) * 2 AS far FROM e)
SELECT run_id, seg, far AS by_pairs, far OR coalesce(step > greatest(bw, 2.0) * 4, false) AS by_physics, far OR coalesce(step > greatest(bw, 3.0) * 4, false) AS by_jump FROM f""",
)
def detect_by_pairs(spark, sf_dir):
    out = variants.detect_pairs(_expected(spark, sf_dir)).withColumnRenamed("suspect", "by_pairs")
    out = variants.detect_pairs(out, jump_floor=2.0).withColumnRenamed("suspect", "by_physics")
    return variants.detect_pairs(out, jump_floor=DEFAULTS.floor).select("run_id", "seg", "by_pairs", "by_physics", F.col("suspect").alias("by_jump"))


@query(
    "detect_with_one_floor",
    f"""WITH {DETECT_SQL} SELECT run_id, seg, CASE WHEN raw IS NULL OR n < 3 THEN true WHEN nl = 0 OR nr = 0 THEN false ELSE abs(raw - med) > greatest(bw, 3.0) * 2 END AS suspect FROM d""",
)
def detect_with_one_floor(spark, sf_dir):
    """Detection by medians without a floor of its own for single frames."""
    p = replace(DEFAULTS, single_floor=DEFAULTS.floor)
    return series.detect(series.local_bandwidth(readings(spark, sf_dir)), p).select("run_id", "seg", "suspect")


@query(
    "ungated_confidence",
    f"""WITH {DETECT_SQL} SELECT run_id, seg, round(CASE WHEN raw IS NULL THEN 0 WHEN n < 3 THEN 30 WHEN nl = 0 OR nr = 0 THEN 100
  ELSE 100 * (0.5 * exp(-abs(raw - med) / greatest(bw, 3.0)) + 0.5 * exp(-coalesce(jerk, 0) / 5.0)) END, 6) AS conf FROM d""",
)
def ungated_confidence(spark, sf_dir):
    return variants.ungated_confidence(series.local_bandwidth(readings(spark, sf_dir))).select("run_id", "seg", F.round("conf", 6).alias("conf"))


@query(
    "smoothed_residual",
    f"""WITH {READINGS_SQL}, v AS (SELECT run_id, seg, coalesce(raw, -1)::DOUBLE AS v, count(*) OVER (PARTITION BY run_id) AS n FROM r),
k AS (SELECT unnest(range(-7, 8)) AS k), o AS (SELECT run_id, seg, v, n, greatest(0, least(n - 1, seg + k)) AS at FROM v CROSS JOIN k),
s AS (SELECT o.run_id, o.seg, any_value(o.v) AS v, any_value(o.n) AS n, median(b.v) AS smooth FROM o JOIN v b ON b.run_id = o.run_id AND b.seg = o.at GROUP BY ALL),
t AS (SELECT *, coalesce(abs(smooth - lag(smooth) OVER (PARTITION BY run_id ORDER BY seg)), 0) AS step FROM s),
q AS (SELECT run_id, seg, v, smooth, greatest(0, least(n - 1, seg + k)) AS at FROM t CROSS JOIN k),
u AS (SELECT q.run_id, q.seg, any_value(q.v) AS v, any_value(q.smooth) AS smooth, greatest(median(b.step), 1.0) AS bw FROM q JOIN t b ON b.run_id = q.run_id AND b.seg = q.at GROUP BY ALL)
SELECT run_id, seg, smooth, bw AS bw_smooth, CASE WHEN v < 0 THEN 0 ELSE round(100 * exp(-abs(v - smooth) / bw), 1) END AS score FROM u""",
)
def smoothed_residual(spark, sf_dir):
    df = readings(spark, sf_dir).withColumn("value", F.coalesce("raw", F.lit(-1)).cast("double"))
    return variants.residual_score(df).select("run_id", "seg", "smooth", "bw_smooth", "score")


@query(
    "detection_rates",
    f"""WITH {CONFIDENCE_SQL}, e AS (SELECT run_id, raw IS NOT NULL AND truth IS NOT NULL AND abs(raw - truth) > 1 AS e, raw IS NOT NULL AND truth IS NOT NULL AND abs(raw - truth) <= 1 AS g, coalesce(conf0, 50) < 70 AS low FROM k)
SELECT run_id, count(*) AS "rows", count(*) FILTER (e) AS errors, count(*) FILTER (g) AS good, round(100.0 * count(*) FILTER (e AND low) / nullif(count(*) FILTER (e), 0), 6) AS detected,
round(100.0 * count(*) FILTER (g AND low) / nullif(count(*) FILTER (g), 0), 6) AS false_alarms, round(100.0 * count(*) FILTER (low) / count(*), 6) AS flagged FROM e GROUP BY ROLLUP (run_id)""",
)
def detection_rates(spark, sf_dir):
    out = variants.detection_rates(series.confidence(series.local_bandwidth(readings(spark, sf_dir))))
    return out.withColumns({c: F.round(c, 6) for c in ("detected", "false_alarms", "flagged")})


@query(
    "region_gain",
    f"""WITH {READINGS_SQL} SELECT run_id, arg_max(raw, seg) FILTER (seg <= 40 AND raw IS NOT NULL) - arg_min(raw, seg) FILTER (seg >= 10 AND raw IS NOT NULL) AS gain FROM r WHERE raw IS NOT NULL GROUP BY run_id""",
)
def region_gain(spark, sf_dir):
    """What each run gains from its tenth to its fortieth row."""
    return variants.region_gain(readings(spark, sf_dir), "seg", "raw", 10, 40)


@query(
    "runs_dimension",
    f"""WITH {READINGS_SQL} SELECT run_id, count(*) AS segments, CAST(sum(len) AS BIGINT) AS frames, round(sum(len) / 30.0, 6) AS duration FROM r GROUP BY run_id""",
)
def runs_dimension(spark, sf_dir):
    return series.runs(readings(spark, sf_dir)).withColumn("duration", F.round("duration", 6))


@query(
    "run_digests",
    f"""WITH {READINGS_SQL} SELECT run_id, sha256(string_agg(seg || ':' || coalesce(CAST(raw AS VARCHAR), ''), chr(10) ORDER BY seg)) AS digest FROM r GROUP BY run_id""",
)
def run_digests(spark, sf_dir):
    return series.run_digests(readings(spark, sf_dir), F.coalesce(F.col("raw").cast("string"), F.lit("")))


@query(
    "calibration_otsu_spread",
    f"""WITH {PX_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY label) // 50) AS step FROM v),
u AS (SELECT label, vec_id, unnest(px) AS bin FROM a WHERE rn % step = 0 AND rn < step * 50), h AS (SELECT label, vec_id, bin, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(n * bin) OVER w AS cm, sum(n) OVER t AS tn, sum(n * bin) OVER t AS tm FROM h WINDOW w AS (PARTITION BY label, vec_id ORDER BY bin), t AS (PARTITION BY label, vec_id)),
b AS (SELECT label, vec_id, bin, CASE WHEN cn > 0 AND tn > cn THEN cn::DOUBLE * (tn - cn) * pow(cm::DOUBLE / cn - (tm - cm)::DOUBLE / (tn - cn), 2) END AS var FROM c),
o AS (SELECT label, vec_id, coalesce(arg_max(bin, {{'v': round(var, 4), 'b': -bin}}) FILTER (var IS NOT NULL), 127) AS threshold FROM b GROUP BY label, vec_id)
SELECT label, CAST(trunc(median(threshold)) AS INTEGER) AS threshold FROM o GROUP BY label""",
)
def calibration_otsu_spread(spark, sf_dir):
    """The sample is the operator: pictures at an even step over each label."""
    return pixels.calibration(_pictures(spark, sf_dir), "label", "vec_id", spread=True)


_SHARES_SQL = f"""{PX_SQL}, w AS (SELECT *, lag(px) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM v),
m AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(list_transform(range(1, 65), lambda i: (px[i] > 127) <> (prev[i] > 127))) AS d FROM w WHERE prev IS NOT NULL),
reach AS (SELECT vec_id, k AS a, k AS b FROM m WHERE d UNION
  SELECT reach.vec_id, a, m.k FROM reach JOIN m ON m.vec_id = reach.vec_id AND m.d AND abs(m.k // 8 - b // 8) <= 1 AND abs(m.k % 8 - b % 8) <= 1),
z AS (SELECT vec_id, a, count(*) AS n FROM reach GROUP BY ALL),
s AS (SELECT vec_id, CAST(coalesce(max(n), 0) AS INTEGER) AS biggest, coalesce(count(*) FILTER (n >= 4) / nullif(count(n), 0), 0)::DOUBLE AS clustered
  FROM (SELECT vec_id FROM w WHERE prev IS NOT NULL) LEFT JOIN z USING (vec_id) GROUP BY vec_id)"""


def _shares(spark, sf_dir):
    df = _pictures(spark, sf_dir).withColumn("b", pixels.binarise(F.col("px"), F.lit(127))).withColumn("prev", F.lag("b").over(Window.partitionBy("label").orderBy("vec_id")))
    rows = df.where("prev is not null").select("vec_id", pixels.changed(F.col("prev"), F.col("b")).alias("mask"), F.lit(8).alias("w"))
    return pixels.component_shares(rows, "mask", "w").select("vec_id", "biggest", "clustered")


@query("component_shares", f"WITH RECURSIVE {_SHARES_SQL} SELECT vec_id, biggest, round(clustered, 6) AS clustered FROM s")
def component_shares(spark, sf_dir):
    return _shares(spark, sf_dir).withColumn("clustered", F.round("clustered", 6))


@query(
    "mask_statistics",
    f"""WITH RECURSIVE {_SHARES_SQL} SELECT vec_id % 3 = 0 AS truth, count(*) AS n, round(median(biggest), 6) AS middle, round(quantile_cont(biggest, 0.9), 6) AS high, max(biggest) AS greatest, min(biggest) AS least,
round(median(clustered), 6) AS share FROM s GROUP BY 1""",
)
def mask_statistics(spark, sf_dir):
    """Components of change masks by class; no table has the truth of a picture, so an id stands in for it."""
    q = F.percentile("biggest", F.array(F.lit(0.5), F.lit(0.9)))
    out = _shares(spark, sf_dir).groupBy((F.col("vec_id") % 3 == 0).alias("truth")).agg(
        F.count(F.lit(1)).alias("n"), q.alias("q"), F.max("biggest").alias("greatest"), F.min("biggest").alias("least"), F.percentile("clustered", F.lit(0.5)).alias("share")
    )
    return out.select("truth", "n", F.round(F.get("q", F.lit(0)), 6).alias("middle"), F.round(F.get("q", F.lit(1)), 6).alias("high"), "greatest", "least", F.round("share", 6).alias("share"))


@query(
    "input_sizes",
    """SELECT p_partkey, CAST(greatest(1, w * 48 // h) AS INTEGER) AS wide, greatest(1, w * 48 // h) = w AND abs(48 - h) <= 0.02 * 48 AS kept
FROM (SELECT p_partkey, CAST(p_partkey % 200 + 1 AS INTEGER) AS w, p_size AS h FROM part)""",
)
def input_sizes(spark, sf_dir):
    w, h = (F.col("p_partkey") % 200 + 1).cast("int"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", pixels.input_width(w, h).cast("int").alias("wide"), pixels.keeps_size(w, h).alias("kept"))


@query(
    "padded_aspects",
    "SELECT p_brand, round(greatest(224 / 48.0::DOUBLE, max((p_partkey % 200 + 1)::DOUBLE / p_size)), 6) AS aspect FROM part GROUP BY p_brand",
)
def padded_aspects(spark, sf_dir):
    w = F.col("p_partkey") % 200 + 1
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(pixels.padded_aspect(w, F.col("p_size"), F.lit(224)), 6).alias("aspect"))
