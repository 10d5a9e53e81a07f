"""Recognised text, settings and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmith.catalog import query
from seriesmith.functions import numeric, text
from seriesmith.params import DEFAULTS
from seriesmith.plans.adapters import table


@query("normalise_text", "SELECT doc_id, translate(text, 'OoQDIl|!ZzSsBGgTt,', '00001111225586677.') AS t FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_text(F.col("text")).alias("t"))


@query(
    "extract_number",
    r"""SELECT p_partkey, CASE WHEN length(trim(p_name)) > 0 THEN
        TRY_CAST(regexp_replace(regexp_extract(replace(translate(trim(p_name), 'OoQDIl|!ZzSsBGgTt,', '00001111225586677.'), ' ', ''), '[0-9]+(?:[.,][0-9]+)?'), '[^0-9]', '', 'g') AS BIGINT) END AS n FROM part""",
)
def extract_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.extract_number(F.col("p_name")).alias("n"))


@query(
    "unwrap_results",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS text, CASE WHEN event_id % 4 IN (0, 1) THEN 0.0 ELSE value END AS score FROM events",
)
def unwrap_results(spark, sf_dir):
    k = F.col("event_id") % 4
    texts = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array("event_type"))
    scores = F.when(k < 2, F.array().cast("array<double>")).otherwise(F.array("value"))
    return table(spark, sf_dir, "events").select("event_id", text.unwrap(texts, scores).alias("u")).select("event_id", "u.text", "u.score")


@query(
    "header_maps",
    """SELECT event_id, event_type AS video, CAST(round(value, 3) AS VARCHAR) AS fps, event_id || ',2,3,4' AS roi, NULL::VARCHAR AS missing FROM events""",
)
def header_maps(spark, sf_dir):
    line = F.concat(F.lit("video=first, fps="), F.round("value", 3).cast("string"), F.lit(", roi="), F.col("event_id").cast("string"), F.lit(",2,3,4, video="), F.col("event_type"))
    m = text.header_map(F.col("line"))
    out = table(spark, sf_dir, "events").select("event_id", line.alias("line")).select("event_id", m.alias("m"))
    return out.select("event_id", *[F.element_at("m", F.lit(k)).alias(k) for k in ("video", "fps", "roi", "missing")])


@query(
    "typed_settings",
    """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN 'abc' WHEN 3 THEN '1, 2,3,' || event_id ELSE '' END AS s FROM events),
p AS (SELECT *, list_transform(string_split(s, ','), lambda x: TRY_CAST(trim(x) AS INTEGER)) AS q FROM v)
SELECT event_id, CAST(trunc(TRY_CAST(trim(s) AS DOUBLE)) AS INTEGER) AS i, TRY_CAST(trim(s) AS DOUBLE) AS f,
       CASE WHEN len(q) = 4 AND list_count(q) = 4 THEN array_to_string(q, ' ') END AS roi FROM p""",
)
def typed_settings(spark, sf_dir):
    k, e = F.col("event_id") % 5, F.col("event_id").cast("string")
    s = F.when(k == 0, F.concat(F.lit(" "), e, F.lit(" "))).when(k == 1, F.col("value").cast("string")).when(k == 2, "abc").when(k == 3, F.concat(F.lit("1, 2,3,"), e)).otherwise("")
    df = table(spark, sf_dir, "events").select("event_id", s.alias("s"))
    roi = F.array_join(F.transform(text.to_roi(F.col("s")), lambda x: x.cast("string")), " ")
    return df.select("event_id", text.to_int(F.col("s")).alias("i"), text.to_float(F.col("s")).alias("f"), roi.alias("roi"))


@query(
    "backend_names",
    """WITH v AS (SELECT event_id, [' onnxruntime', 'TensorRT ', 'tensorrt+onnxruntime', 'CPU', 'other'][event_id % 5 + 1] AS b FROM events)
SELECT event_id, CASE lower(trim(b)) WHEN 'onnxruntime' THEN 'cpu' WHEN 'cpu' THEN 'cpu' WHEN 'tensorrt' THEN 'tensorrt' WHEN 'tensorrt+onnxruntime' THEN 'auto' WHEN 'auto' THEN 'auto' END AS backend FROM v""",
)
def backend_names(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (" onnxruntime", "TensorRT ", "tensorrt+onnxruntime", "CPU", "other")])
    return table(spark, sf_dir, "events").select("event_id", text.backend_name(F.get(names, (F.col("event_id") % 5).cast("int"))).alias("backend"))


@query(
    "settings_precedence",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 400.0 END, CASE WHEN event_id % 2 = 0 THEN value END, 400.0) AS max_speed FROM events""",
)
def settings_precedence(spark, sf_dir):
    e = F.col("event_id")
    value = text.setting(F.when(e % 3 == 0, F.lit(400.0)), F.when(e % 2 == 0, F.col("value")), F.lit(DEFAULTS.max_speed))
    return table(spark, sf_dir, "events").select("event_id", value.alias("max_speed"))


@query(
    "durations",
    """WITH s AS (SELECT event_id, CAST(round_even(greatest(value * 97 - 50, 0), 0) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS d FROM s""",
)
def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.duration(F.col("value") * 97 - 50).alias("d"))


@query(
    "units_and_rounding",
    """SELECT event_id, round(value / 3.6, 6) AS ms, round(value * 1.609344, 6) AS kmh, CAST(round_even(value * 2, 0) AS BIGINT) AS even, round_even(floor(value * 8) / 8, 2) AS cents,
round(event_id / CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 29.97 END, 6) AS seconds,
CASE WHEN event_id % 5 = 0 THEN 25.0 WHEN event_id % 7 = 0 THEN 50.0 ELSE 30.0 END AS fps,
CASE WHEN value - 20 >= 0 THEN CAST(trunc(value - 20) AS INTEGER) END AS reading FROM events""",
)
def units_and_rounding(spark, sf_dir):
    v, e = F.col("value"), F.col("event_id")
    fps = numeric.frame_rate(F.when(e % 5 == 0, 25.0).otherwise(-1.0), F.when(e % 7 == 0, 50.0), DEFAULTS)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(v / 3.6, 6).alias("ms"),
        F.round(numeric.to_kmh(v, "mph"), 6).alias("kmh"),
        F.bround(v * 2, 0).cast("long").alias("even"),
        F.bround(F.floor(v * 8) / 8, 2).alias("cents"),
        F.round(numeric.seconds(e, F.when(e % 3 == 0, 0.0).otherwise(29.97)), 6).alias("seconds"),
        fps.alias("fps"),
        numeric.valid_reading(v - 20).alias("reading"),
    )


@query(
    "clamped_boxes",
    """WITH b AS (SELECT event_id, CAST(event_id % 250 AS INTEGER) - 20 AS x1, CAST(event_id * 7 % 150 AS INTEGER) - 10 AS y1, CAST(event_id * 3 % 260 AS INTEGER) AS x2, CAST(event_id * 5 % 140 AS INTEGER) AS y2 FROM events),
c AS (SELECT *, least(greatest(x2, 1), 199) AS r, least(greatest(y2, 1), 99) AS d FROM b)
SELECT event_id, least(greatest(x1, 0), r - 1) AS x1, least(greatest(y1, 0), d - 1) AS y1, r AS x2, d AS y2, x2 > x1 AND y2 > y1 AS valid FROM c""",
)
def clamped_boxes(spark, sf_dir):
    e = F.col("event_id")
    i = lambda c: c.cast("int")
    df = table(spark, sf_dir, "events").select("event_id", (i(e % 250) - 20).alias("x1"), (i(e * 7 % 150) - 10).alias("y1"), i(e * 3 % 260).alias("x2"), i(e * 5 % 140).alias("y2"))
    box = numeric.clamp_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(200), F.lit(100))
    valid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    out = df.select("event_id", box.alias("b"), valid.alias("valid"))
    return out.select("event_id", *[F.get("b", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], "valid")


@query(
    "ctc_decode",
    """WITH g AS (SELECT vec_id, unnest(range(len(embedding))) AS k, embedding FROM embeddings),
s AS (SELECT vec_id, k, CAST(floor(abs(embedding[k + 1]) * 20) AS INTEGER) % 5 AS i, round_even(abs(embedding[k + 1])::DOUBLE * 1e5, 0) AS p FROM g),
l AS (SELECT *, lag(i) OVER (PARTITION BY vec_id ORDER BY k) AS b FROM s),
t AS (SELECT vec_id, string_agg(['blank', 'a', 'b', 'c', ' '][i + 1], '' ORDER BY k) AS text, round_even(sum(p) / count(*), 0) / 1e5 AS score FROM l WHERE i <> 0 AND (b IS NULL OR i <> b) GROUP BY vec_id)
SELECT vec_id, coalesce(text, '') AS text, coalesce(score, 0.0) AS score FROM embeddings LEFT JOIN t USING (vec_id)""",
)
def ctc_decode(spark, sf_dir):
    chars = F.array(*[F.lit(c) for c in ("blank", "a", "b", "c", " ")])
    indices = F.transform("embedding", lambda x: F.floor(F.abs(x) * 20).cast("int") % 5)
    df = table(spark, sf_dir, "embeddings").select("vec_id", indices.alias("i"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("p"))
    return df.select("vec_id", text.ctc_decode(F.col("i"), F.col("p"), chars).alias("d")).select("vec_id", "d.text", F.col("d.score").alias("score"))


@query(
    "dictionary_join",
    """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def dictionary_join(spark, sf_dir):
    # the two dimensions are small by nature; Spark broadcasts them by their size
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer")
    return c.join(nation, c["c_nationkey"] == nation["n_nationkey"]).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query(
    "formatted_stats",
    """SELECT event_type, printf('n=%d', count(*)) || ' | ' || printf('avg=%.2f', avg(value)) || ' | ' || printf('max=%.1f', max(value)) AS line FROM events GROUP BY event_type""",
)
def formatted_stats(spark, sf_dir):
    line = F.concat_ws(" | ", F.format_string("n=%d", F.count(F.lit(1))), F.format_string("avg=%.2f", F.avg("value")), F.format_string("max=%.1f", F.max("value")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(line.alias("line"))


@query("bytes_by_source", "SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def bytes_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
