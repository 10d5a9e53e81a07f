"""Joins, aggregations, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmith.catalog import query
from seriesmith.operators import evaluation, joins, series
from seriesmith.plans.adapters import READINGS_SQL, readings, table
from seriesmith.sources import logs
from seriesmith.queries.scoring import CONFIDENCE_SQL, DETECT_SQL


@query(
    "segments_with_truth",
    f"WITH {READINGS_SQL} SELECT r.run_id, r.seg, raw, t.truth FROM r LEFT JOIN (SELECT run_id, seg, truth FROM r WHERE truth IS NOT NULL) t USING (run_id, seg)",
)
def segments_with_truth(spark, sf_dir):
    df = readings(spark, sf_dir)
    return df.select("run_id", "seg", "raw").join(df.where("truth is not null").select("run_id", "seg", "truth"), ["run_id", "seg"], "left")


@query(
    "log_against_truth",
    f"WITH {READINGS_SQL} SELECT a.run_id, a.seg, a.raw, b.truth FROM r a JOIN r b USING (run_id, seg) WHERE abs(a.raw - b.truth) > 1e-9",
)
def log_against_truth(spark, sf_dir):
    df = readings(spark, sf_dir)
    return df.select("run_id", "seg", "raw").join(df.select("run_id", "seg", "truth"), ["run_id", "seg"]).where(F.abs(F.col("raw") - F.col("truth")) > 1e-9)


@query("labelled_documents", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) ORDER BY doc_id")
def labelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic").orderBy("doc_id")


@query("orphan_documents", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def orphan_documents(spark, sf_dir):
    return logs.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("semi_join_orders", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_join_orders(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query(
    "full_outer_counts",
    """SELECT coalesce(a.k, b.k) AS k, orders, shipments FROM (SELECT o_orderdate AS k, count(*) AS orders FROM orders GROUP BY 1) a
FULL JOIN (SELECT l_shipdate AS k, count(*) AS shipments FROM lineitem GROUP BY 1) b ON a.k = b.k""",
)
def full_outer_counts(spark, sf_dir):
    """By day: the last days have shipments and no orders, the first ones the reverse."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("k")).agg(F.count(F.lit(1)).alias("shipments"))
    return a.join(b, "k", "full").select("k", "orders", "shipments")


@query(
    "edits_overlay",
    f"""WITH {READINGS_SQL}, e AS (SELECT run_id, seg, value FROM (SELECT run_id, seg + CASE WHEN event_id % 200 = 0 THEN 100000 ELSE 0 END AS seg, event_id % 300 + 0.5 AS value FROM r WHERE event_id % 10 = 0))
SELECT r.run_id, r.seg, coalesce(CAST(round_even(e.value, 0) AS INTEGER), raw) AS value, e.value IS NOT NULL AS pinned FROM r LEFT JOIN e USING (run_id, seg)""",
)
def edits_overlay(spark, sf_dir):
    df = readings(spark, sf_dir)
    seg = F.col("seg") + F.when(F.col("event_id") % 200 == 0, 100000).otherwise(0)
    edits = df.where("event_id % 10 = 0").select("run_id", seg.alias("seg"), (F.col("event_id") % 300 + 0.5).alias("value"))
    return joins.overlay(df.select("run_id", "seg", F.col("raw").alias("value")), edits)


#: The right curve of every order.
_CURVES = """
o AS (SELECT o_custkey % 50 AS k, o_orderkey AS id, o_totalprice AS x FROM orders),
q AS (SELECT o_custkey % 50 AS k, round(o_totalprice, -3) AS x, max(o_orderkey) AS v FROM orders GROUP BY 1, 2)"""


def _curves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 50)
    left = o.select("k", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    right = o.groupBy("k", F.round("o_totalprice", -3).alias("x")).agg(F.max("o_orderkey").alias("v"))
    return left, right


@query(
    "whole_interpolation_join",
    f"""WITH {_CURVES}, p AS (SELECT o.*, q.x AS px, q.v AS pv FROM o ASOF LEFT JOIN q ON o.k = q.k AND o.x >= q.x),
n AS (SELECT p.*, q.x AS nx, q.v AS nv FROM p ASOF LEFT JOIN q ON p.k = q.k AND p.x <= q.x)
SELECT k, id, round(CASE WHEN px = x THEN pv WHEN px IS NULL THEN nv WHEN nx IS NULL THEN pv ELSE pv + (nv - pv) * CASE WHEN nx - px > 1e-3 THEN (x - px) / (nx - px) ELSE 0.5 END END + 1e-7, 4) AS v FROM n""",
)
def whole_interpolation_join(spark, sf_dir):
    left, right = _curves(spark, sf_dir)
    return joins.interpolate_onto(left, right, ["k"], "x", "v", "out").select("k", "id", F.round(F.col("out") + 1e-7, 4).alias("v"))


@query(
    "whole_nearest_join",
    f"""WITH {_CURVES}, p AS (SELECT o.*, q.x AS px, q.v AS pv FROM o ASOF LEFT JOIN q ON o.k = q.k AND o.x >= q.x),
n AS (SELECT p.*, q.x AS nx, q.v AS nv FROM p ASOF LEFT JOIN q ON p.k = q.k AND p.x <= q.x)
SELECT k, id, CAST(CASE WHEN px = x OR nx IS NULL OR abs(px - x) < abs(nx - x) THEN pv ELSE nv END AS DOUBLE) AS v FROM n""",
)
def whole_nearest_join(spark, sf_dir):
    left, right = _curves(spark, sf_dir)
    return joins.nearest_onto(left, right, ["k"], "x", "v", "out").select("k", "id", F.col("out").alias("v"))


@query(
    "frame_in_segment",
    f"""WITH {READINGS_SQL}, s AS (SELECT run_id, seg, seg * 10 AS "start", seg * 10 + len + 4 AS "end" FROM r), f AS (SELECT run_id, CAST(event_id % 700 AS INTEGER) AS frame, event_id FROM r)
SELECT f.run_id, f.event_id, f.frame, s.seg FROM f LEFT JOIN s ON f.run_id = s.run_id AND f.frame BETWEEN s."start" AND s."end" """,
)
def frame_in_segment(spark, sf_dir):
    df = readings(spark, sf_dir)
    segments = df.select("run_id", "seg", (F.col("seg") * 10).alias("start"), (F.col("seg") * 10 + F.col("len") + 4).alias("end"))
    frames = df.select("run_id", (F.col("event_id") % 700).cast("int").alias("frame"), "event_id")
    return joins.containing_segment(frames, segments).select("run_id", "event_id", "frame", "seg")


@query(
    "regression_gate",
    f"""WITH {READINGS_SQL}, n AS (SELECT run_id, count(*) FILTER (raw IS NULL) AS final FROM r GROUP BY run_id HAVING run_id % 9 <> 0),
b AS (SELECT run_id, count(*) FILTER (raw IS NULL) + CASE WHEN run_id % 4 = 0 THEN -1 ELSE 0 END AS final FROM r GROUP BY run_id),
j AS (SELECT b.run_id, b.final AS base, n.final AS now FROM b LEFT JOIN n USING (run_id)),
u AS (SELECT * FROM j UNION ALL SELECT NULL, CAST(sum(base) AS BIGINT), CAST(sum(now) AS BIGINT) FROM j)
SELECT run_id, base, now, coalesce(now <= base, false) AS passed FROM u""",
)
def regression_gate(spark, sf_dir):
    per = readings(spark, sf_dir).groupBy("run_id").agg(evaluation.count_if(F.col("raw").isNull()).alias("final"))
    base = per.withColumn("final", F.col("final") + F.when(F.col("run_id") % 4 == 0, -1).otherwise(0))
    return joins.gate(per.where("run_id % 9 <> 0"), base)


@query(
    "detection_confusion",
    f"""WITH {DETECT_SQL}, e AS (SELECT run_id, abs(raw - truth) > 1 AS e, suspect AS s FROM d WHERE raw IS NOT NULL AND truth IS NOT NULL),
g AS (SELECT run_id, count(*) FILTER (e AND s) AS tp, count(*) FILTER (e AND NOT s) AS fn, count(*) FILTER (NOT e AND s) AS fp, count(*) FILTER (NOT e AND NOT s) AS tn FROM e GROUP BY ROLLUP (run_id))
SELECT run_id, tp, fn, fp, tn, round(tp / greatest(tp + fn, 1), 6) AS recall, round(fp / greatest(fp + tn, 1), 6) AS fpr FROM g""",
)
def detection_confusion(spark, sf_dir):
    out = evaluation.confusion(series.detect(series.local_bandwidth(readings(spark, sf_dir))))
    return out.withColumn("recall", F.round("recall", 6)).withColumn("fpr", F.round("fpr", 6))


@query(
    "missed_by_size",
    f"""WITH {DETECT_SQL} SELECT abs(raw - truth) AS size, count(*) AS n FROM d WHERE raw IS NOT NULL AND truth IS NOT NULL AND abs(raw - truth) > 1 AND NOT suspect GROUP BY 1 ORDER BY 1""",
)
def missed_by_size(spark, sf_dir):
    df = series.detect(series.local_bandwidth(readings(spark, sf_dir))).withColumn("size", F.abs(F.col("raw") - F.col("truth")))
    return df.where((F.col("size") > 1) & ~F.col("suspect")).groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size")


@query(
    "error_classes",
    """WITH e AS (SELECT abs(l_quantity - 25) AS e FROM lineitem), c AS (SELECT CASE WHEN e < 1.5 THEN '1' WHEN e < 2.5 THEN '2' WHEN e < 5 THEN '3-4' WHEN e < 10 THEN '5-9' WHEN e < 20 THEN '10-19' ELSE '20+' END AS class FROM e)
SELECT class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM c GROUP BY class""",
)
def error_classes(spark, sf_dir):
    c = evaluation.error_class(F.abs(F.col("l_quantity") - 25))
    counts = table(spark, sf_dir, "lineitem").groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("class", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 4).alias("share"))


@query(
    "threshold_sweep",
    f"""WITH {CONFIDENCE_SQL}, e AS (SELECT conf0, abs(raw - truth) > 1 AS e FROM k WHERE raw IS NOT NULL AND truth IS NOT NULL)
SELECT t AS threshold, count(*) FILTER (e AND conf0 < t) AS caught, count(*) FILTER (NOT e AND conf0 < t) AS false_alarms, count(*) FILTER (e) AS errors, count(*) FILTER (NOT e) AS good
FROM e CROSS JOIN (VALUES (10.0), (20.0), (30.0), (50.0), (70.0), (90.0)) v(t) GROUP BY t""",
)
def threshold_sweep(spark, sf_dir):
    df = series.confidence(series.local_bandwidth(readings(spark, sf_dir)))
    return evaluation.threshold_sweep(df, [10.0, 20.0, 30.0, 50.0, 70.0, 90.0]).drop("recall", "fpr")


@query(
    "best_threshold",
    f"""WITH {CONFIDENCE_SQL}, e AS (SELECT conf0, abs(raw - truth) > 1 AS e FROM k WHERE raw IS NOT NULL AND truth IS NOT NULL),
s AS (SELECT t, count(*) FILTER (e AND conf0 < t) / greatest(count(*) FILTER (e), 1) AS recall, count(*) FILTER (NOT e AND conf0 < t) / greatest(count(*) FILTER (NOT e), 1) AS fpr
  FROM e CROSS JOIN (VALUES (10.0), (20.0), (30.0), (50.0), (70.0), (90.0)) v(t) GROUP BY t)
SELECT t AS threshold, round(recall, 6) AS recall FROM s WHERE fpr <= 0.5 ORDER BY s.recall DESC, t LIMIT 1""",
)
def best_threshold(spark, sf_dir):
    df = series.confidence(series.local_bandwidth(readings(spark, sf_dir)))
    sweep = evaluation.threshold_sweep(df, [10.0, 20.0, 30.0, 50.0, 70.0, 90.0])
    return evaluation.best_threshold(sweep, 0.5).withColumn("recall", F.round("recall", 6))


@query(
    "percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def percentiles(spark, sf_dir):
    cuts = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    q = F.percentile("value", F.array(*[F.lit(v) for v in cuts.values()]))
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(q.alias("q"))
    return out.select("event_type", *[F.round(F.get("q", F.lit(k)), 6).alias(n) for k, n in enumerate(cuts)])


@query(
    "resource_statistics",
    """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT user_id, arg_max(v, epoch_us(ts)) FILTER (v IS NOT NULL) AS last, max(v) AS peak, round(avg(v), 6) AS mean, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS elapsed FROM s GROUP BY user_id""",
)
def resource_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    last = F.max_by("v", F.when(F.col("v").isNotNull(), F.col("ts")))
    sec = F.expr("timestampdiff(SECOND, date_trunc('second', min(ts)), date_trunc('second', max(ts)))")
    return df.groupBy("user_id").agg(last.alias("last"), F.max("v").alias("peak"), F.round(F.avg("v"), 6).alias("mean"), sec.alias("elapsed"))


@query("profile_sums", "SELECT event_type, user_id % 10 AS k, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def profile_sums(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("k")).agg(F.round(F.sum("value"), 4).alias("total"))


@query(
    "best_configuration",
    """SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def best_configuration(spark, sf_dir):
    # the least struct per group needs no sort of the groups
    key = F.struct("o_orderstatus", (-F.col("o_totalprice")).alias("p"), "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", key).alias("o_orderkey"))


@query(
    "any_and_best",
    """SELECT user_id, bool_or(value > 200) AS any_high, arg_max(event_type, value) AS best, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id""",
)
def any_and_best(spark, sf_dir):
    # of equal values the first row in the table's files, as SQL meets them; nan is the greatest value, and rows without type or value are none
    place = F.struct(~F.isnan("value"), -F.col("value"), F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.when(F.col("event_type").isNotNull() & F.col("value").isNotNull(), place).alias("_place"))
    return df.groupBy("user_id").agg(
        F.bool_or(F.col("value") > 200).alias("any_high"), F.min_by("event_type", "_place").alias("best"), evaluation.count_if(F.col("event_type") == "click").alias("clicks")
    )


@query(
    "change_checksums",
    "SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY user_id",
)
def change_checksums(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.sum("event_id").alias("total")
    )


@query("content_hashes", "SELECT doc_id, sha256(text) AS h FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query(
    "two_level_peak",
    "SELECT user_id, max(s) AS peak FROM (SELECT user_id, date_trunc('day', ts) AS d, round(sum(value), 4) AS s FROM events GROUP BY 1, 2) GROUP BY user_id",
)
def two_level_peak(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.round(F.sum("value"), 4).alias("s"))
    return per.groupBy("user_id").agg(F.max("s").alias("peak"))


@query(
    "multi_key_top",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 25",
)
def multi_key_top(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return df.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "missing_last",
    "SELECT c_custkey, n FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) ORDER BY CASE WHEN n = 0 THEN 999 ELSE n END, c_custkey LIMIT 15",
)
def missing_last(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    df = table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return df.orderBy(F.when(F.col("n") == 0, 999).otherwise(F.col("n")), "c_custkey").limit(15)


@query(
    "strided_rows",
    f"""WITH {READINGS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM r)
SELECT run_id, seg FROM n WHERE seg % greatest(1, n // 10) = 0 AND seg // greatest(1, n // 10) < 10""",
)
def strided_rows(spark, sf_dir):
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    df = readings(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(series.whole_run()))
    return df.where((F.col("seg") % step == 0) & (F.floor(F.col("seg") / step) < 10)).select("run_id", "seg")


@query("keys_in_both", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def keys_in_both(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("keys_missing", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def keys_missing(spark, sf_dir):
    """Customers who ordered nothing."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("keys_of_either", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def keys_of_either(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select(F.col("s_nationkey").alias("k"))).distinct()


@query(
    "concatenated_parts",
    f"WITH {READINGS_SQL} SELECT run_id, seg, 'calibration' AS part FROM r WHERE seg < 5 UNION ALL SELECT run_id, seg, 'cpu' FROM r WHERE seg BETWEEN 5 AND 14 UNION ALL SELECT run_id, seg, 'gpu' FROM r WHERE seg > 14",
)
def concatenated_parts(spark, sf_dir):
    df = readings(spark, sf_dir).select("run_id", "seg")
    part = lambda c, name: df.where(c).withColumn("part", F.lit(name))
    return part("seg < 5", "calibration").unionByName(part("seg between 5 and 14", "cpu")).unionByName(part("seg > 14", "gpu"))


@query(
    "parameter_grid",
    f"""WITH {READINGS_SQL} SELECT t AS threshold, k AS reach, run_id, count(*) FILTER (raw > t AND seg % k = 0) AS n FROM r CROSS JOIN (VALUES (10), (50), (100)) a(t) CROSS JOIN (VALUES (1), (2)) b(k) GROUP BY ALL""",
)
def parameter_grid(spark, sf_dir):
    # a grid of known size is a literal array beside each row, not a join
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("reach")) for t in (10, 50, 100) for k in (1, 2)])
    df = readings(spark, sf_dir).select("run_id", "seg", "raw", F.inline(grid))
    return df.groupBy("threshold", "reach", "run_id").agg(evaluation.count_if((F.col("raw") > F.col("threshold")) & (F.col("seg") % F.col("reach") == 0)).alias("n"))


@query(
    "cube_of_orders",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
)
def cube_of_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "ranks",
    """SELECT p_partkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS tile, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
)
def ranks(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    tile = F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), tile.alias("tile"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd")
    )


@query(
    "distinct_counts",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1",
)
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders")
    )


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n")
    )


@query(
    "sql_front_end",
    """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, round(total, 2) AS total FROM customer JOIN big ON c_custkey = o_custkey WHERE total > (SELECT avg(total) FROM big) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)""",
)
def sql_front_end(spark, sf_dir):
    for name in ("orders", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(
        """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
        SELECT c_custkey, c_name, round(total, 2) AS total FROM customer JOIN big ON c_custkey = o_custkey
        WHERE total > (SELECT avg(total) FROM big) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)"""
    )
