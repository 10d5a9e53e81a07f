"""Overlapping segments, sketches, table functions, lateral joins and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.catalog import query
from seriesmith.functions import tables
from seriesmith.operators import evaluation, joins, series, sketches
from seriesmith.plans import chain
from seriesmith.plans.adapters import READINGS_SQL, readings, table
from seriesmith.queries.chain_sql import ORACLES
from seriesmith.queries.files import scratch
from seriesmith.sources import logs
from seriesmith.streaming import windows

_NESTED = """
s AS (SELECT run_id, seg, seg * 10 AS "start", seg * 10 + len + 4 AS "end" FROM r
      UNION ALL SELECT run_id, seg + 100000, seg * 10 - 35, seg * 10 + 170 FROM r WHERE len = 4
      UNION ALL SELECT run_id, 200000, -5, max(seg) * 10 FROM r GROUP BY run_id),
f AS (SELECT run_id, event_id, CAST(event_id % 700 - 10 AS INTEGER) AS frame FROM r)"""


def _nested(spark, sf_dir):
    """Short segments of every reading, some twenty times as long around one in four, and one over the whole run."""
    df = readings(spark, sf_dir)
    at = F.col("seg") * 10
    short = df.select("run_id", "seg", at.alias("start"), (at + F.col("len") + 4).alias("end"))
    middle = df.where("len = 4").select("run_id", (F.col("seg") + 100000).alias("seg"), (at - 35).alias("start"), (at + 170).alias("end"))
    whole = df.groupBy("run_id").agg(F.lit(200000).alias("seg"), F.lit(-5).alias("start"), (F.max("seg") * 10).alias("end"))
    return df.select("run_id", "event_id", (F.col("event_id") % 700 - 10).cast("int").alias("frame")), short.unionByName(middle).unionByName(whole)


@query("frame_in_segments", f"""WITH {READINGS_SQL}, {_NESTED} SELECT f.run_id, f.event_id, f.frame, s.seg FROM f LEFT JOIN s ON f.run_id = s.run_id AND f.frame BETWEEN s."start" AND s."end" """)
def frame_in_segments(spark, sf_dir):
    frames, segments = _nested(spark, sf_dir)
    return joins.containing_segments(frames, segments, "left")


_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    "sketched_quantiles",
    f"""WITH {READINGS_SQL}, n AS (SELECT run_id, count(raw) AS n FROM r GROUP BY run_id HAVING count(raw) > 0 UNION ALL SELECT NULL, count(raw) FROM r)
SELECT run_id, share, n, TRUE AS held, TRUE AS held_different FROM n, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS share)""",
)
def sketched_quantiles(spark, sf_dir):
    """Quantiles of each run and of all from sketches, and whether ranks and numbers of different values keep to their errors.

    All is merged from the sketches of the runs. The exact side counts the rows below and up to each quantile.
    """
    df = readings(spark, sf_dir).where("raw is not null")
    runs = sketches.sketch(df, ["run_id"], "raw")
    every = sketches.merge(runs, []).withColumn("run_id", F.lit(None).cast(df.schema["run_id"].dataType))
    both = runs.unionByName(every, allowMissingColumns=True)
    asked = both.select("run_id", "n", sketches.different("distinct").alias("different"), F.explode(F.array(*[F.struct(F.lit(q).alias("share"), sketches.quantile("quantiles", q).alias("at")) for q in _SHARES])).alias("q"))
    counts = df.groupBy("run_id", "raw").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.unionByName(counts.groupBy("raw").agg(F.sum("c").alias("c")).withColumn("run_id", F.lit(None).cast(df.schema["run_id"].dataType)))
    exact = counts.withColumnRenamed("run_id", "key")
    met = asked.join(exact, F.col("run_id").eqNullSafe(F.col("key")))
    below, upto = (F.sum(F.when(c, F.col("c")).otherwise(0)) for c in (F.col("raw") < F.col("q.at"), F.col("raw") <= F.col("q.at")))
    found = met.groupBy("run_id", "n", "different", "q").agg(below.alias("below"), upto.alias("upto"), F.count(F.lit(1)).alias("kinds"))
    slack = F.col("n") * sketches.RANK_ERROR + 1
    rank = F.col("q.share") * F.col("n")
    held = (F.col("below") - slack <= rank) & (rank <= F.col("upto") + slack)
    return found.select("run_id", F.col("q.share").alias("share"), "n", held.alias("held"), (F.abs(F.col("different") - F.col("kinds")) <= F.col("kinds") * sketches.DISTINCT_ERROR + 1).alias("held_different"))


@query("sections_by_table_function", ORACLES["acceleration_sections"])
def sections_by_table_function(spark, sf_dir):
    tables.register(spark)
    steps = series.pair_accelerations(readings(spark, sf_dir), 30.0).select("run_id", "seg", F.col("accel").cast("double").alias("accel"))
    return spark.sql("SELECT * FROM steady_sections(TABLE({steps}), 8.0D)", steps=steps)


@query("fastest_of_each_run", f"WITH {READINGS_SQL} SELECT run_id, seg, raw FROM r WHERE raw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY raw DESC, seg) <= 3")
def fastest_of_each_run(spark, sf_dir):
    """A lateral join: the best three rows for every run."""
    df = readings(spark, sf_dir).where("raw is not null").select("run_id", "seg", "raw")
    return spark.sql(
        """SELECT runs.run_id, best.seg, best.raw FROM (SELECT DISTINCT run_id FROM {steps}) AS runs,
        LATERAL (SELECT seg, raw FROM {steps} AS s WHERE s.run_id = runs.run_id ORDER BY raw DESC, seg LIMIT 3) AS best""",
        steps=df,
    )


@query(
    "jumps_by_doubling",
    f"""WITH RECURSIVE {READINGS_SQL}, t(least) AS (SELECT 1 UNION ALL SELECT least * 2 FROM t WHERE least < 256),
j AS (SELECT run_id, abs(raw - lag(raw) OVER (PARTITION BY run_id ORDER BY seg)) AS jump FROM r WHERE raw IS NOT NULL)
SELECT least, count(jump) AS n FROM t LEFT JOIN j ON jump >= least GROUP BY least""",
)
def jumps_by_doubling(spark, sf_dir):
    """Jumps between neighbours of at least 1, 2, 4 ... : thresholds by a recursive query, nine rows whatever the tables."""
    df = readings(spark, sf_dir).where("raw is not null").select("run_id", "raw", F.abs(F.col("raw") - F.lag("raw").over(series.run_order())).alias("jump"))
    return spark.sql(
        """WITH RECURSIVE t(least) AS (SELECT 1 UNION ALL SELECT least * 2 FROM t WHERE least < 256),
        j AS (SELECT jump, count(*) AS c FROM {steps} WHERE jump IS NOT NULL GROUP BY jump)
        SELECT least, coalesce(sum(c), 0) AS n FROM t LEFT JOIN j ON jump >= least GROUP BY least""",
        steps=df,
    )


@query(
    "finalized_values",
    f"""WITH {READINGS_SQL}, f AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN event_id % 250 ELSE raw END AS final, run_id % 2 = 0 AND seg % 5 = 0 AS pin FROM r),
s AS (SELECT *, coalesce(final, -1) AS speed FROM f),
d AS (SELECT *, CASE WHEN speed >= 0 THEN coalesce(lag(speed) OVER w / 3.6 / 30.0, 0) ELSE 0 END AS step FROM s WINDOW w AS (PARTITION BY run_id ORDER BY seg))
SELECT run_id, seg AS frame, round(sum(step) OVER (PARTITION BY run_id ORDER BY seg ROWS UNBOUNDED PRECEDING), 2) AS dist, CAST(speed AS BIGINT) AS speed,
CASE WHEN pin THEN 22 WHEN raw IS NULL THEN 12 WHEN final <> raw THEN 11 ELSE 21 END AS flag FROM d""",
)
def finalized_values(spark, sf_dir):
    """Every second run gets a whole list of values, some of them pinned."""
    df = readings(spark, sf_dir).withColumn("len", F.lit(1)).withColumn("final", F.col("raw")).withColumn("conf", F.lit(100.0))
    even = df.where("run_id % 2 = 0")
    lists = even.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("seg", (F.col("event_id") % 250).cast("double").alias("v")))).alias("all"))
    values = lists.select("run_id", F.transform("all", lambda x: x["v"]).alias("values"))
    return chain.finalize_values(df, values, even.where("seg % 5 = 0").select("run_id", "seg")).withColumn("speed", F.col("speed").cast("long"))


@query(
    "log_curves",
    f"WITH {READINGS_SQL} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seg) - 1 AS INTEGER) AS idx, round(seg / 25.0, 6) AS t, round(mid / 4.0, 2) AS dist, CAST(coalesce(raw, -1) AS DOUBLE) AS speed, len AS flag FROM r",
)
def log_curves(spark, sf_dir):
    """Logs with 25 frames a second in their headers, read again as curves in seconds."""
    df = readings(spark, sf_dir).select("run_id", F.col("seg").alias("frame"), (F.col("mid") / 4.0).alias("dist"), F.coalesce("raw", F.lit(-1)).alias("speed"), F.col("len").alias("flag"))
    head = df.select("run_id").distinct().select("run_id", F.array(F.lit("log v1"), F.lit("fps=25.000")).alias("header"))
    logs.write_logs(df, head, path := scratch(spark, "logs"))
    run = F.regexp_extract("path", r"run_id=(\d+)", 1).cast("long")
    return logs.read_curves(spark, f"{path}/*/*.txt").select(run.alias("run_id"), "idx", F.round("t", 6).alias("t"), "dist", "speed", "flag")


@query(
    "baseline_round_trip",
    f"WITH {READINGS_SQL} SELECT run_id, count(*) FILTER (raw IS NOT NULL AND truth IS NOT NULL) AS seg, count(*) FILTER (abs(raw - truth) > 1) AS raw FROM r GROUP BY run_id",
)
def baseline_round_trip(spark, sf_dir):
    """A graded result kept as a baseline and read again for the same tolerance."""
    df = readings(spark, sf_dir)
    known = F.col("raw").isNotNull() & F.col("truth").isNotNull()
    graded = df.groupBy("run_id").agg(evaluation.count_if(known).alias("seg"), evaluation.count_if(F.abs(F.col("raw") - F.col("truth")) > 1).alias("wrong")).withColumnRenamed("wrong", "raw")
    logs.write_baseline(graded, path := scratch(spark, "baseline"), 1.0, "1")
    return logs.read_baseline(spark, path, 1.0).select("run_id", "seg", "raw")


@query(
    "sliding_windows",
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS "start" FROM events) SELECT "start", count(*) AS n FROM w GROUP BY 1""",
)
def sliding_windows(spark, sf_dir):
    out = windows.sliding(table(spark, sf_dir, "events"), "6 hours", "3 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("changed_values", f"WITH {READINGS_SQL} SELECT run_id, count(*) FILTER (truth IS NOT NULL AND (raw IS NULL OR raw <> truth)) AS changed FROM r GROUP BY run_id")
def changed_values(spark, sf_dir):
    df = readings(spark, sf_dir)
    return chain.change_count(df.withColumnRenamed("raw", "final"), df.withColumnRenamed("truth", "final"))
