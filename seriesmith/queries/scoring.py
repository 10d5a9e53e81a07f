"""Detection, scoring and repair of runs of readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmith.catalog import query
from seriesmith.functions.numeric import is_corrected, is_trusted, needs_review
from seriesmith.operators import evaluation, islands, joins, sections, series, variants
from seriesmith.params import DEFAULTS
from seriesmith.plans import chain
from seriesmith.plans.adapters import READINGS_SQL, readings

DETECT_SQL = READINGS_SQL + """,
b0 AS (SELECT *, lag(mid) OVER w AS pm, abs(raw - lag(raw) OVER w) AS dv FROM r WINDOW w AS (PARTITION BY run_id ORDER BY seg)),
b1 AS (SELECT *, least(30 * greatest(coalesce(median(mid - pm) OVER (PARTITION BY run_id), 1), 1), 120) AS half FROM b0),
bw AS (
  SELECT a.run_id, a.seg, coalesce(median(b.dv), 0) AS bw
  FROM b1 a LEFT JOIN b1 b ON a.run_id = b.run_id AND b.dv IS NOT NULL AND b.mid BETWEEN a.mid - a.half AND a.mid + a.half AND b.pm >= a.mid - a.half
  GROUP BY a.run_id, a.seg),
c AS (
  SELECT r.*, bw, median(raw) OVER f AS med, count(raw) OVER f AS n, count(raw) OVER lf AS nl, count(raw) OVER rf AS nr,
         abs(lead(raw) OVER w - 2 * raw + lag(raw) OVER w) AS jerk
  FROM r JOIN bw USING (run_id, seg)
  WINDOW w AS (PARTITION BY run_id ORDER BY seg),
         f AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING),
         lf AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
         rf AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
d AS (
  SELECT *, CASE WHEN raw IS NULL OR n < 3 THEN true WHEN nl = 0 OR nr = 0 THEN false
                 ELSE abs(raw - med) > greatest(bw, CASE WHEN len = 1 THEN 2.0 ELSE 3.0 END) * 2 END AS suspect
  FROM c)"""

#: Nearest rows before and after for which ok holds, in table a, as lt, lv, rt, rv; then the line through those within 120.
LINE_SQL = """
n0 AS (
  SELECT *, last_value(CASE WHEN ok THEN {{'t': mid, 'v': raw}} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp,
            first_value(CASE WHEN ok THEN {{'t': mid, 'v': raw}} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rp
  FROM {0}),
n1 AS (SELECT *, CASE WHEN mid - lp.t <= 120 THEN lp END AS l, CASE WHEN rp.t - mid <= 120 THEN rp END AS rr FROM n0),
line AS (
  SELECT *, CASE WHEN l IS NOT NULL AND rr IS NOT NULL
                 THEN l.v + (rr.v - l.v) * CASE WHEN rr.t - l.t > 1e-3 THEN (mid - l.t)::DOUBLE / (rr.t - l.t) ELSE 0.5 END
                 ELSE coalesce(l.v, rr.v)::DOUBLE END AS line
  FROM n1)"""

CONFIDENCE_SQL = DETECT_SQL + """,
ms AS (SELECT *, 100 * exp(-abs(raw - med) / greatest(bw, 3.0)) AS ms FROM d),
k AS (
  SELECT *, CASE WHEN raw IS NULL THEN 0 WHEN n < 3 THEN 30 WHEN nl = 0 OR nr = 0 THEN 100 WHEN ms >= 50 THEN ms
                 WHEN jerk IS NOT NULL THEN 0.7 * ms + 0.3 * 100 * exp(-jerk / 3.0) ELSE ms END AS conf0,
            CASE WHEN raw IS NULL THEN 'none' WHEN n < 3 THEN 'sparse' WHEN nl = 0 OR nr = 0 THEN 'edge' WHEN ms >= 50 THEN 'fit'
                 WHEN jerk IS NOT NULL THEN 'jerk' ELSE 'fit' END AS branch
  FROM ms)"""


@query(
    "funnel_of_repairs",
    f"""WITH {DETECT_SQL}, a AS (SELECT *, NOT suspect AND raw IS NOT NULL AS ok FROM d), {LINE_SQL.format('a')},
f AS (SELECT *, CASE WHEN suspect AND line IS NOT NULL AND (raw IS NULL OR abs(line - raw) > 6) THEN CAST(round_even(line, 0) AS INTEGER) ELSE raw END AS corr FROM line),
e AS (SELECT run_id, abs(raw - truth) > 1 AS re, corr IS NULL OR abs(corr - truth) > 1 AS fe, corr IS NOT NULL AND corr <> raw AS ch FROM f WHERE raw IS NOT NULL AND truth IS NOT NULL)
SELECT run_id, count(*) AS seg, count(*) FILTER (re) AS raw, count(*) FILTER (re AND ch AND NOT fe) AS fix, count(*) FILTER (re AND ch AND fe) AS fix_wrong,
       count(*) FILTER (re AND NOT ch) AS missed, count(*) FILTER (NOT re AND ch AND fe) AS harm, count(*) FILTER (fe) AS final
FROM e GROUP BY ROLLUP (run_id)""",
)
def funnel_of_repairs(spark, sf_dir):
    fixed = series.correct(series.detect(series.local_bandwidth(readings(spark, sf_dir))))
    return evaluation.funnel(fixed, corr="fixed")


@query("local_bandwidth", f"WITH {DETECT_SQL} SELECT run_id, seg, bw FROM d")
def local_bandwidth(spark, sf_dir):
    return series.local_bandwidth(readings(spark, sf_dir)).select("run_id", "seg", "bw")


@query("detect_outliers", f"WITH {DETECT_SQL} SELECT run_id, seg, suspect FROM d")
def detect_outliers(spark, sf_dir):
    return series.detect(series.local_bandwidth(readings(spark, sf_dir))).select("run_id", "seg", "suspect")


@query(
    "correct_by_anchors",
    f"""WITH {DETECT_SQL}, a AS (SELECT *, NOT suspect AND raw IS NOT NULL AS ok FROM d), {LINE_SQL.format('a')}
SELECT run_id, seg, CASE WHEN suspect AND line IS NOT NULL AND (raw IS NULL OR abs(line - raw) > 6) THEN CAST(round_even(line, 0) AS INTEGER) ELSE raw END AS fixed FROM line""",
)
def correct_by_anchors(spark, sf_dir):
    return series.correct(series.detect(series.local_bandwidth(readings(spark, sf_dir)))).select("run_id", "seg", "fixed")


@query("confidence_first_pass", f"WITH {CONFIDENCE_SQL} SELECT run_id, seg, round(conf0, 6) AS conf, branch FROM k")
def confidence_first_pass(spark, sf_dir):
    return series.confidence(series.local_bandwidth(readings(spark, sf_dir))).select("run_id", "seg", F.round("conf", 6).alias("conf"), "branch")


@query("confidence_with_islands")
def confidence_with_islands(spark, sf_dir):
    return chain.score(readings(spark, sf_dir)).select("run_id", "seg", F.round("conf", 6).alias("conf"), "anchor", F.round("fill", 6).alias("fill"))


@query("repair_chain")
def repair_chain(spark, sf_dir):
    return chain.repair(readings(spark, sf_dir)).select("run_id", "seg", "raw", "corr", "final")


@query("repair_log")
def repair_log(spark, sf_dir):
    return chain.log_rows(chain.repair(readings(spark, sf_dir)))


@query("repair_funnel")
def repair_funnel(spark, sf_dir):
    return evaluation.funnel(chain.repair(readings(spark, sf_dir)), corr="final")


@query(
    "anchors_and_fill",
    f"""WITH {CONFIDENCE_SQL},
a AS (SELECT *, raw IS NOT NULL AND conf0 >= 20 AND NOT (conf0 < 50 AND coalesce(jerk BETWEEN 5 AND 40, false)) AS ok FROM k), {LINE_SQL.format('a')}
SELECT run_id, seg, ok AS anchor, round(line, 6) AS fill FROM line""",
)
def anchors_and_fill(spark, sf_dir):
    out = series.fill_curve(series.anchors(series.confidence(series.local_bandwidth(readings(spark, sf_dir)))))
    return out.select("run_id", "seg", "anchor", F.round("fill", 6).alias("fill"))


@query(
    "spike_pass",
    f"""WITH {READINGS_SQL},
s AS (SELECT *, median(raw) OVER a AS ml, median(raw) OVER b AS mr, count(raw) OVER a AS cl, count(raw) OVER b AS cr, list(raw) OVER a AS la, list(raw) OVER b AS lb
      FROM r WINDOW a AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
t AS (SELECT *, raw - ml AS dl, raw - mr AS dr, CAST(round_even(CASE WHEN abs(raw - ml) >= abs(raw - mr) THEN ml ELSE mr END, 0) AS INTEGER) AS target FROM s)
SELECT run_id, seg, CASE WHEN raw IS NOT NULL AND len = 1 AND cl >= 2 AND cr >= 2 AND dl * dr > 0 AND greatest(abs(dl), abs(dr)) >= 2
  AND NOT list_contains(list_concat(la, lb), raw) AND abs(target - raw) >= 2 THEN target ELSE raw END AS spiked FROM t""",
)
def spike_pass(spark, sf_dir):
    return series.spike_pass(readings(spark, sf_dir), "raw").withColumnRenamed("spiked", "s").select("run_id", "seg", F.col("s").alias("spiked"))


@query(
    "running_distance",
    f"""WITH {READINGS_SQL}, v AS (SELECT run_id, seg, coalesce(raw, -1) AS speed FROM r),
s AS (SELECT *, CASE WHEN speed >= 0 THEN coalesce(lag(speed) OVER w / 3.6 * (seg - lag(seg) OVER w) / 30.0, 0) ELSE 0 END AS step FROM v WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, seg, round(sum(step) OVER (PARTITION BY run_id ORDER BY seg ROWS UNBOUNDED PRECEDING), 2) AS dist FROM s""",
)
def running_distance(spark, sf_dir):
    return series.distance(readings(spark, sf_dir).withColumn("speed", F.coalesce("raw", F.lit(-1))), "seg", "speed").select("run_id", "seg", "dist")


@query(
    "trim_and_rebase",
    f"""WITH {READINGS_SQL}, f AS (SELECT *, min(seg) FILTER (raw > 150) OVER (PARTITION BY run_id) AS k FROM r)
SELECT run_id, seg, mid - first_value(mid) OVER (PARTITION BY run_id ORDER BY seg) AS t FROM f WHERE k IS NULL OR seg >= k""",
)
def trim_and_rebase(spark, sf_dir):
    df = readings(spark, sf_dir).select("run_id", F.col("seg").alias("idx"), F.col("mid").alias("t"), (F.col("raw") - 150).alias("speed"))
    return series.trim_start(df, rebase=("t",)).select("run_id", F.col("idx").alias("seg"), "t")


@query(
    "rotate_lap",
    f"""WITH {READINGS_SQL}, n AS (SELECT *, CAST((seg + 7) % count(*) OVER (PARTITION BY run_id) AS INTEGER) AS pos FROM r)
SELECT run_id, seg, pos, ((mid - first_value(mid) OVER (PARTITION BY run_id ORDER BY pos)) % 500 + 500) % 500 AS x_lap FROM n""",
)
def rotate_lap(spark, sf_dir):
    df = series.rotate(readings(spark, sf_dir), 7, "seg").withColumn("lap", F.lit(500))
    return series.lap_base(df, "mid", "lap").select("run_id", "seg", F.col("at").alias("pos"), "x_lap")


SEGMENTS_SQL = READINGS_SQL + """,
g AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY run_id ORDER BY seg) THEN 1 ELSE 0 END AS b FROM r),
h AS (SELECT *, CAST(sum(b) OVER (PARTITION BY run_id ORDER BY seg ROWS UNBOUNDED PRECEDING) AS INTEGER) AS s FROM g)"""


def _segments(spark, sf_dir):
    df = readings(spark, sf_dir).select("run_id", F.col("seg").alias("frame"), "event_type", F.coalesce("raw", F.lit(0)).cast("double").alias("sharp"))
    return series.cut_at(df, F.col("event_type") != F.lag("event_type").over(Window.partitionBy("run_id").orderBy("frame")))


@query(
    "segments_by_change",
    f"""WITH {SEGMENTS_SQL}
SELECT run_id, s AS seg, min(seg) AS "start", max(seg) AS "end", CAST(count(*) AS INTEGER) AS n,
       list_sort(list(seg))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS mid, arg_max(seg, coalesce(raw, 0) * 1000000 - seg) AS rep
FROM h GROUP BY run_id, s""",
)
def segments_by_change(spark, sf_dir):
    return series.roll_up(_segments(spark, sf_dir)).select("run_id", "seg", "start", "end", "n", "mid", "rep")


@query("expand_to_frames", f"WITH {SEGMENTS_SQL} SELECT run_id, s AS seg, seg AS frame FROM h")
def expand_to_frames(spark, sf_dir):
    return joins.expand_frames(series.roll_up(_segments(spark, sf_dir))).select("run_id", "seg", "frame")


@query(
    "segment_length_groups",
    f"""WITH {SEGMENTS_SQL}, l AS (SELECT run_id, s, count(*) AS n FROM h GROUP BY run_id, s)
SELECT n AS length, count(*) AS segments, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share,
       round(sum(count(*)) OVER (ORDER BY n) * 100.0 / sum(count(*)) OVER (), 6) AS cumulative FROM l GROUP BY n""",
)
def segment_length_groups(spark, sf_dir):
    counts = series.roll_up(_segments(spark, sf_dir)).groupBy(F.col("n").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("segments"))
    total = F.sum("segments").over(Window.partitionBy(F.lit(0)))
    upto = F.sum("segments").over(Window.partitionBy(F.lit(0)).orderBy("length"))
    return counts.select("length", "segments", F.round(F.col("segments") * 100.0 / total, 6).alias("share"), F.round(upto * 100.0 / total, 6).alias("cumulative"))


@query(
    "flag_ranges",
    f"""WITH {READINGS_SQL}, g AS (SELECT *, raw IS NULL AS f, seg - row_number() OVER (PARTITION BY run_id, raw IS NULL ORDER BY seg) AS d FROM r)
SELECT run_id, f AS missing, min(seg) AS first, max(seg) AS last FROM g GROUP BY run_id, f, d""",
)
def flag_ranges(spark, sf_dir):
    df = series.islands_of(readings(spark, sf_dir).withColumn("missing", F.col("raw").isNull()), F.col("missing"))
    return df.groupBy("run_id", "island", "missing").agg(F.min("seg").alias("first"), F.max("seg").alias("last")).drop("island")


@query(
    "first_descent",
    f"""WITH {READINGS_SQL}, l AS (SELECT *, lag(raw) OVER (PARTITION BY run_id ORDER BY seg) AS p FROM r)
SELECT run_id, min(seg) FILTER (raw < p) AS seg FROM l GROUP BY run_id""",
)
def first_descent(spark, sf_dir):
    df = readings(spark, sf_dir).withColumn("p", F.lag("raw").over(series.run_order()))
    return df.groupBy("run_id").agg(F.min(F.when(F.col("raw") < F.col("p"), F.col("seg"))).alias("seg"))


@query(
    "same_segment_mask",
    f"WITH {SEGMENTS_SQL} SELECT run_id, seg AS frame, coalesce(lead(s) OVER (PARTITION BY run_id ORDER BY seg) = s, false) AS joined FROM h",
)
def same_segment_mask(spark, sf_dir):
    w = Window.partitionBy("run_id").orderBy("frame")
    return _segments(spark, sf_dir).select("run_id", "frame", F.coalesce(F.lead("seg").over(w) == F.col("seg"), F.lit(False)).alias("joined"))


@query(
    "progress_gate",
    f"""WITH {READINGS_SQL}, e AS (SELECT run_id, seg, coalesce(raw, 0) AS pct, len AS phase FROM r),
g AS (SELECT *, max(pct * 10 + phase) OVER (PARTITION BY run_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
SELECT run_id, seg, pct, phase FROM g WHERE best IS NULL OR pct * 10 + phase > best""",
)
def progress_gate(spark, sf_dir):
    df = readings(spark, sf_dir).select("run_id", "seg", F.coalesce("raw", F.lit(0)).alias("pct"), F.col("len").alias("phase"))
    return series.progress_gate(df)


@query(
    "pair_acceleration",
    f"""WITH {READINGS_SQL}, a AS (SELECT *, raw - lag(raw) OVER w AS dv, (mid - lag(mid) OVER w) / 30.0 AS dt FROM r WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, seg, round(dv / CASE WHEN dt <= 0 THEN 1 / 30.0 ELSE dt END, 6) AS accel FROM a""",
)
def pair_acceleration(spark, sf_dir):
    return series.pair_accelerations(readings(spark, sf_dir)).select("run_id", "seg", F.round("accel", 6).alias("accel"))


@query(
    "jump_islands",
    f"""WITH {READINGS_SQL}, a AS (SELECT *, raw - lag(raw) OVER w AS d, abs(mid - lag(mid) OVER w) / 30.0 AS dt FROM r WINDOW w AS (PARTITION BY run_id ORDER BY seg)),
s AS (SELECT *, CASE WHEN abs(d) > 50.0 * dt * 3.6 * 0.1 THEN sign(d) END AS sg FROM a),
n AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS ls,
                first_value(sg IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS rs FROM s)
SELECT run_id, seg, raw IS NOT NULL AND (sg IS NOT NULL OR coalesce(ls <> rs, false)) AS jumped FROM n""",
)
def jump_islands(spark, sf_dir):
    return series.jump_islands(readings(spark, sf_dir), mult=0.1).select("run_id", "seg", "jumped")


@query(
    "sliding_median_edges",
    f"""WITH {READINGS_SQL}, v AS (SELECT run_id, seg, coalesce(raw, 0)::DOUBLE AS v FROM r),
e AS (SELECT run_id, min(seg) AS a, max(seg) AS z FROM v GROUP BY run_id),
x AS (SELECT v.run_id, v.seg, w.v FROM v JOIN e USING (run_id) CROSS JOIN range(-3, 4) o(k) JOIN v w ON w.run_id = v.run_id AND w.seg = least(greatest(v.seg + k, a), z))
SELECT run_id, seg, median(v) AS smooth_median, round(avg(v), 6) AS smooth_mean FROM x GROUP BY run_id, seg""",
)
def sliding_median_edges(spark, sf_dir):
    df = readings(spark, sf_dir).withColumn("v", F.coalesce("raw", F.lit(0)))
    out = series.sliding(series.sliding(df, "v", 3, "median", "smooth_median"), "v", 3, "mean", "smooth_mean")
    return out.select("run_id", "seg", "smooth_median", F.round("smooth_mean", 6).alias("smooth_mean"))


_WEIGHTS = series.savgol_coefficients(7, 3)
_SG = " + ".join(f"({c!r}) * lag(v, {3 - k}) OVER w" if k < 3 else f"({c!r}) * lead(v, {k - 3}) OVER w" for k, c in enumerate(_WEIGHTS))


@query(
    "savitzky_golay",
    f"""WITH {READINGS_SQL}, v AS (SELECT run_id, seg, coalesce(raw, 0)::DOUBLE AS v FROM r),
s AS (SELECT *, {_SG} AS s, count(*) OVER (PARTITION BY run_id) AS n FROM v WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, seg, round(CASE WHEN n < 7 THEN v WHEN seg < 3 THEN first_value(s IGNORE NULLS) OVER f WHEN seg >= n - 3 THEN last_value(s IGNORE NULLS) OVER f ELSE s END, 6) AS smooth
FROM s WINDOW f AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def savitzky_golay(spark, sf_dir):
    df = readings(spark, sf_dir).withColumn("v", F.coalesce("raw", F.lit(0)).cast("double"))
    return series.savgol(df, "v").select("run_id", "seg", F.round("smooth", 6).alias("smooth"))


@query(
    "smoothing_windows",
    """SELECT s.strength, n, CASE WHEN s.strength > 0 AND n >= 5 THEN
         CASE WHEN least(greatest(CAST(trunc(n * s.strength / 100 * 0.0175) AS BIGINT), 5), n - 2) % 2 = 0
              THEN greatest(least(greatest(CAST(trunc(n * s.strength / 100 * 0.0175) AS BIGINT), 5), n - 2) - 1, 3)
              ELSE least(greatest(CAST(trunc(n * s.strength / 100 * 0.0175) AS BIGINT), 5), n - 2) END END AS win
       FROM (SELECT count(*) AS n FROM events GROUP BY user_id) g CROSS JOIN (VALUES (0.0), (50.0), (400.0), (1500.0)) s(strength)""",
)
def smoothing_windows(spark, sf_dir):
    grid = F.explode(F.array(*[F.lit(x) for x in (0.0, 50.0, 400.0, 1500.0)]))
    df = readings(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("n", grid.alias("strength"))
    return df.select("strength", "n", series.smoothing_window(F.col("n"), F.col("strength")).cast("long").alias("win"))


@query(
    "region_statistics",
    f"""WITH {READINGS_SQL}, v AS (SELECT run_id, seg, mid::DOUBLE AS t, seg * 10.0::DOUBLE AS x, coalesce(raw, 0) AS v FROM r),
s AS (SELECT run_id, (v + lag(v) OVER w) / 2.0 AS m, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx FROM v WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, round(coalesce(sum(m / 3.6 * dt), 0), 4) AS metres, round(coalesce(sum(CASE WHEN m > 0 AND dx > 0 THEN dx / (m / 3.6) END), 0), 4) AS seconds FROM s GROUP BY run_id""",
)
def region_statistics(spark, sf_dir):
    df = readings(spark, sf_dir).select("run_id", F.col("seg").alias("idx"), F.col("mid").cast("double").alias("t"), (F.col("seg") * 10.0).alias("dist"), F.coalesce("raw", F.lit(0)).alias("speed"))
    return series.region_statistics(df).select("run_id", F.round("metres", 4).alias("metres"), F.round("seconds", 4).alias("seconds"))


@query(
    "physics_check",
    f"""WITH {READINGS_SQL}, n AS (SELECT *, greatest(abs(raw - lag(raw) OVER w), abs(raw - lead(raw) OVER w)) AS step,
    least(greatest(abs(mid - lag(mid) OVER w) / 30.0, 1e-3), greatest(abs(lead(mid) OVER w - mid) / 30.0, 1e-3)) AS dt FROM r WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, seg, coalesce(step <= 50.0 * 3.6 * dt * 3.0, true) AS plausible FROM n""",
)
def physics_check(spark, sf_dir):
    return series.physics_check(readings(spark, sf_dir)).select("run_id", "seg", "plausible")


@query(
    "needs_review",
    f"""WITH {DETECT_SQL}, a AS (SELECT *, NOT suspect AND raw IS NOT NULL AS ok FROM d), {LINE_SQL.format('a')},
f AS (SELECT *, CASE WHEN suspect AND line IS NOT NULL AND (raw IS NULL OR abs(line - raw) > 6) THEN CAST(round_even(line, 0) AS INTEGER) ELSE raw END AS v FROM line)
SELECT run_id, count(*) FILTER (v IS NULL OR (raw IS NOT NULL AND raw <> v)) AS review, count(*) FILTER (v IS NOT NULL AND raw IS DISTINCT FROM v) AS corrected FROM f GROUP BY run_id""",
)
def review_counts(spark, sf_dir):
    df = series.correct(series.detect(series.local_bandwidth(readings(spark, sf_dir))))
    return df.groupBy("run_id").agg(
        evaluation.count_if(needs_review(F.col("raw"), F.col("fixed"))).alias("review"),
        evaluation.count_if(F.col("fixed").isNotNull() & ~F.col("raw").eqNullSafe(F.col("fixed"))).alias("corrected"),
    )


@query(
    "flags",
    f"""WITH {CONFIDENCE_SQL}, f AS (SELECT run_id, seg, CASE WHEN event_id % 17 = 0 THEN 22 WHEN raw IS NULL THEN 12 WHEN truth IS NOT NULL AND truth <> raw THEN 11
  WHEN conf0 >= 20 THEN 21 ELSE 0 END AS flag FROM k)
SELECT run_id, seg, flag, flag BETWEEN 10 AND 19 AS corrected, flag BETWEEN 20 AND 29 AS trusted FROM f""",
)
def flags(spark, sf_dir):
    df = series.confidence(series.local_bandwidth(readings(spark, sf_dir)))
    f = chain.flag(F.col("raw"), F.col("truth"), F.col("conf"), F.col("event_id") % 17 == 0, DEFAULTS)
    return df.select("run_id", "seg", f.alias("flag")).withColumn("corrected", is_corrected(F.col("flag"))).withColumn("trusted", is_trusted(F.col("flag")))


@query("acceleration_sections")
def acceleration_sections(spark, sf_dir):
    return sections.sections(readings(spark, sf_dir), 8.0)


@query("rebuilt_curve")
def rebuilt_curve(spark, sf_dir):
    df = series.anchors(series.confidence(series.local_bandwidth(readings(spark, sf_dir))))
    trusted = sections.trusted_sections(df, sections.sections(df, 8.0), 4)
    return sections.apply_rebuilt(sections.reconstruct(df, trusted), 5.0).select("run_id", "seg", F.round("rebuilt", 6).alias("rebuilt"), "patched")


@query(
    "median_of_all_pairs",
    f"""WITH {READINGS_SQL}, p AS (
  SELECT m.run_id, m.seg, a.raw + (b.raw - a.raw) * CASE WHEN b.mid - a.mid > 1e-3 THEN (m.mid - a.mid)::DOUBLE / (b.mid - a.mid) ELSE 0.5 END AS v
  FROM r m JOIN r a ON a.run_id = m.run_id AND a.seg < m.seg AND a.raw IS NOT NULL AND m.mid - a.mid <= 60
           JOIN r b ON b.run_id = m.run_id AND b.seg > m.seg AND b.raw IS NOT NULL AND b.mid - m.mid <= 60)
SELECT r.run_id, r.seg, round(median(v) + 1e-7, 4) AS expected FROM r LEFT JOIN p USING (run_id, seg) GROUP BY r.run_id, r.seg""",
)
def median_of_all_pairs(spark, sf_dir):
    """All pairs of the window."""
    return joins.median_of_pairs(readings(spark, sf_dir), 60).select("run_id", "seg", F.round(F.col("expected") + 1e-7, 4).alias("expected"))


@query(
    "residual_score",
    f"""WITH {READINGS_SQL}, s AS (SELECT *, median(raw) OVER f AS med, stddev_pop(raw) OVER f AS sd FROM r WINDOW f AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
SELECT run_id, seg, round(coalesce(100 * exp(-abs(raw - med) / greatest(sd, 3.0)), 50), 1) AS score, round(sd, 6) AS spread FROM s""",
)
def residual_score(spark, sf_dir):
    f = series.run_order().rowsBetween(-7, 7)
    df = readings(spark, sf_dir).withColumn("med", F.percentile("raw", F.lit(0.5)).over(f)).withColumn("sd", F.stddev_pop("raw").over(f))
    score = F.coalesce(F.lit(100.0) * F.exp(-F.abs(F.col("raw") - F.col("med")) / F.greatest("sd", F.lit(3.0))), F.lit(50.0))
    return df.select("run_id", "seg", F.round(score, 1).alias("score"), F.round("sd", 6).alias("spread"))


@query(
    "combined_signals",
    f"""WITH {CONFIDENCE_SQL}, s AS (SELECT run_id, seg, conf0 AS a, least(100, coalesce(bw, 0)) AS b, len * 25.0 AS f FROM k),
z AS (SELECT *, least(greatest(0.5 * a + 0.3 * b + 0.2 * f, 0), 100) AS z, least(a, b) AS m FROM s)
SELECT run_id, seg, round(least(z, CASE WHEN m < 30 THEN 25 ELSE 100 END, CASE WHEN m < 50 THEN 50 ELSE 100 END, CASE WHEN m < 70 THEN 69 ELSE 100 END, CASE WHEN f < 50 THEN 50 ELSE 100 END), 4) AS score FROM z""",
)
def combined_signals(spark, sf_dir):
    df = series.confidence(series.local_bandwidth(readings(spark, sf_dir)))
    a, b, f = F.col("conf"), F.least(F.lit(100.0), F.coalesce("bw", F.lit(0.0))), F.col("len") * 25.0
    m = F.least(a, b)
    score = variants.combine_signals([(a, 0.5), (b, 0.3), (f, 0.2)], [(m, 30, 25), (m, 50, 50), (m, 70, 69), (f, 50, 50)])
    return df.select("run_id", "seg", F.round(score, 4).alias("score"))


@query(
    "context_rows",
    f"""WITH {READINGS_SQL}, c AS (SELECT *, list(coalesce(raw, -1)) OVER (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS around FROM r)
SELECT run_id, seg, array_to_string(around, ' ') AS around FROM c WHERE raw IS NOT NULL AND truth IS NOT NULL AND abs(raw - truth) > 1""",
)
def context_rows(spark, sf_dir):
    around = F.collect_list(F.coalesce("raw", F.lit(-1)).cast("string")).over(series.run_order().rowsBetween(-3, 3))
    df = readings(spark, sf_dir).withColumn("around", F.array_join(around, " "))
    return df.where(F.abs(F.col("raw") - F.col("truth")) > 1).select("run_id", "seg", "around")


@query(
    "island_runs",
    f"""WITH {READINGS_SQL}, g AS (SELECT *, seg - row_number() OVER (PARTITION BY run_id, raw ORDER BY seg) AS d FROM r)
SELECT run_id, raw AS value, CAST(sum(len) AS BIGINT) AS frames, count(*) AS n FROM g WHERE raw IS NOT NULL GROUP BY run_id, raw, d""",
)
def island_runs(spark, sf_dir):
    df = series.islands_of(readings(spark, sf_dir), F.col("raw")).where(F.col("raw").isNotNull())
    return df.groupBy("run_id", "island", F.col("raw").alias("value")).agg(F.sum("len").alias("frames"), F.count(F.lit(1)).alias("n")).drop("island")


@query(
    "run_bounds_exact",
    f"""WITH {READINGS_SQL}, g AS (SELECT *, seg - row_number() OVER (PARTITION BY run_id, raw ORDER BY seg) AS d FROM r WHERE raw IS NOT NULL),
b AS (SELECT *, min(seg) OVER w AS run_l, max(seg) OVER w AS run_r, CAST(sum(len) OVER w AS BIGINT) AS run_frames FROM g WINDOW w AS (PARTITION BY run_id, raw, d))
SELECT run_id, seg, run_l, run_r, run_frames FROM b""",
)
def run_bounds_exact(spark, sf_dir):
    df = islands.exact_bounds(readings(spark, sf_dir)).where(F.col("raw").isNotNull())
    return df.select("run_id", "seg", "run_l", "run_r", F.col("run_frames").cast("long").alias("run_frames"))


@query("section_totals")
def section_totals(spark, sf_dir):
    """Trusted sections per run: how many, how many row pairs, mean acceleration."""
    df = readings(spark, sf_dir)
    trusted = sections.trusted_sections(df, sections.sections(df, 8.0), 4)
    return trusted.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") - F.col("l")).alias("pairs"), F.round(F.avg("accel"), 6).alias("accel"))


@query(
    "finalized_log",
    f"""WITH {READINGS_SQL}, e AS (SELECT run_id, seg, event_id % 300 AS v FROM r WHERE event_id % 10 = 0),
f AS (SELECT r.run_id, r.seg, coalesce(v, raw) AS final, v IS NOT NULL AS pin, raw FROM r LEFT JOIN e USING (run_id, seg)),
s AS (SELECT *, coalesce(final, -1) AS speed FROM f),
d AS (SELECT *, CASE WHEN speed >= 0 THEN coalesce(lag(speed) OVER w / 3.6 / 30.0, 0) ELSE 0 END AS step FROM s WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, seg AS frame, round(sum(step) OVER (PARTITION BY run_id ORDER BY seg ROWS UNBOUNDED PRECEDING), 2) AS dist, CAST(speed AS BIGINT) AS speed,
CASE WHEN pin THEN 22 WHEN raw IS NULL THEN 12 ELSE 21 END AS flag FROM d""",
)
def finalized_log(spark, sf_dir):
    df = readings(spark, sf_dir).withColumn("len", F.lit(1)).withColumn("final", F.col("raw")).withColumn("conf", F.lit(100.0))
    edits = df.where("event_id % 10 = 0").select("run_id", "seg", (F.col("event_id") % 300).cast("double").alias("value"))
    return chain.finalize(df, edits).withColumn("speed", F.col("speed").cast("long"))
