"""DuckDB SQL of the repair chain and of the sections: what steps from row to row is a recursive table.

Nothing is bounded here: runs of agreeing readings grow as far as they go, and a path is compared over
every speed. Rows of small tables only, since each step is a pass.
"""

from __future__ import annotations

from seriesmith.queries.scoring import CONFIDENCE_SQL, LINE_SQL, READINGS_SQL

#: conf after the islands, anchors (ok) and the line between them: table line.
SCORE_SQL = CONFIDENCE_SQL + """,
k2 AS MATERIALIZED (SELECT * FROM k),
gl(run_id, seg, l, low, high) AS (
  SELECT run_id, seg, seg, raw, raw FROM k2 WHERE raw IS NOT NULL
  UNION ALL
  SELECT g.run_id, g.seg, p.seg, least(g.low, p.raw), greatest(g.high, p.raw)
  FROM gl g JOIN k2 p ON p.run_id = g.run_id AND p.seg = g.l - 1
  WHERE p.raw IS NOT NULL AND greatest(g.high, p.raw) - least(g.low, p.raw) <= 2),
gs AS MATERIALIZED (SELECT run_id, seg, min(l) AS l, min(low) AS low, max(high) AS high FROM gl GROUP BY run_id, seg),
gr(run_id, seg, l, r, low, high) AS (
  SELECT run_id, seg, l, seg, low, high FROM gs
  UNION ALL
  SELECT g.run_id, g.seg, g.l, p.seg, least(g.low, p.raw), greatest(g.high, p.raw)
  FROM gr g JOIN k2 p ON p.run_id = g.run_id AND p.seg = g.r + 1
  WHERE p.raw IS NOT NULL AND greatest(g.high, p.raw) - least(g.low, p.raw) <= 2),
ru AS MATERIALIZED (SELECT run_id, seg, l, max(r) AS r, min(low) AS low, max(high) AS high FROM gr GROUP BY run_id, seg, l),
inside AS (
  SELECT u.run_id, u.seg, sum(p.len) AS frames, median(p.raw) AS med FROM ru u JOIN k2 p ON p.run_id = u.run_id AND p.seg BETWEEN u.l AND u.r GROUP BY ALL),
outside AS (
  SELECT u.run_id, u.seg, count(*) AS n, median(p.raw) AS med
  FROM ru u JOIN k2 p ON p.run_id = u.run_id AND p.raw IS NOT NULL AND abs(p.seg - u.seg) <= 10 AND (p.seg < u.l OR p.seg > u.r) GROUP BY ALL),
caps AS MATERIALIZED (
  SELECT u.run_id, u.l, u.r FROM ru u JOIN k2 USING (run_id, seg) JOIN inside i USING (run_id, seg) JOIN outside o USING (run_id, seg)
  WHERE branch IN ('fit', 'jerk') AND i.frames < CASE WHEN u.low = u.high THEN 3 ELSE 5 END AND o.n >= 3 AND abs(i.med - o.med) > greatest(bw, 3.0) * 3),
kc AS (
  SELECT k2.*, CASE WHEN raw IS NOT NULL AND branch IN ('fit', 'jerk') AND EXISTS (SELECT 1 FROM caps WHERE caps.run_id = k2.run_id AND k2.seg BETWEEN caps.l AND caps.r)
                    THEN least(conf0, 15) ELSE conf0 END AS conf FROM k2),
a AS MATERIALIZED (SELECT *, raw IS NOT NULL AND conf >= 20 AND NOT (conf < 50 AND coalesce(jerk BETWEEN 5 AND 40, false)) AS ok FROM kc),""" + LINE_SQL.format("a")

_STEP = "greatest(0.0::DOUBLE, abs({0} - {1})::DOUBLE - free) * greatest(0.0::DOUBLE, abs({0} - {1})::DOUBLE - free)"
_SPEEDS = "range(0, 401)"
_SEEN = f"list_transform({_SPEEDS}, lambda s: CASE WHEN aim IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, abs(s - aim)::DOUBLE / greatest(1.0::DOUBLE, abs(aim)::DOUBLE)) END)"

#: The cheapest path through each stretch without anchors, then the pass for spikes: table rep with corr and final.
REPAIR_SQL = SCORE_SQL + f""",
u AS (
  SELECT *, ok AND raw BETWEEN 0 AND 400 AS fixed, lag(mid) OVER w AS pmid, lag(raw) OVER w AS praw, lead(raw) OVER w AS nraw, lead(mid) OVER w AS nmid FROM line WINDOW w AS (PARTITION BY run_id ORDER BY seg)),
s0 AS (SELECT *, sum(CAST(fixed AS INTEGER)) OVER (PARTITION BY run_id ORDER BY seg) AS stretch FROM u),
st AS MATERIALIZED (
  SELECT run_id, stretch, seg, row_number() OVER w AS pos, count(*) OVER (PARTITION BY run_id, stretch) AS n,
         CASE WHEN line > 0 THEN line WHEN raw > 0 THEN raw::DOUBLE END AS aim,
         CASE WHEN stretch > 0 AND row_number() OVER w = 1 THEN praw END AS opens,
         least(50.0::DOUBLE * CASE WHEN mid - pmid > 0 THEN (mid - pmid) / 30.0::DOUBLE ELSE 1 / 30.0::DOUBLE END * 3.6::DOUBLE, 4.0::DOUBLE) AS free,
         least(50.0::DOUBLE * CASE WHEN nmid - mid > 0 THEN (nmid - mid) / 30.0::DOUBLE ELSE 1 / 30.0::DOUBLE END * 3.6::DOUBLE, 4.0::DOUBLE) AS nfree,
         CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY run_id, stretch) THEN nraw END AS nraw, nmid
  FROM s0 WHERE NOT fixed WINDOW w AS (PARTITION BY run_id, stretch ORDER BY seg)),
seen AS MATERIALIZED (SELECT *, {_SEEN} AS obs FROM st),
vit(run_id, stretch, pos, cost) AS (
  SELECT run_id, stretch, pos, CASE WHEN opens IS NULL THEN obs ELSE list_transform({_SPEEDS}, lambda s: 0.1::DOUBLE + {_STEP.format('s', 'opens')} + obs[s + 1]) END
  FROM seen WHERE pos = 1
  UNION ALL
  SELECT v.run_id, v.stretch, x.pos,
         list_transform({_SPEEDS}, lambda s: list_min(list_transform({_SPEEDS}, lambda q: v.cost[q + 1] + {_STEP.format('s', 'q')})) + x.obs[s + 1])
  FROM vit v JOIN seen x ON x.run_id = v.run_id AND x.stretch = v.stretch AND x.pos = v.pos + 1),
costs AS MATERIALIZED (SELECT v.*, x.n, x.seg, x.free, x.nfree, x.nraw, x.nmid FROM vit v JOIN st x USING (run_id, stretch, pos)),
ends AS (
  SELECT *, CASE WHEN nmid IS NULL THEN cost ELSE list_transform({_SPEEDS}, lambda q: cost[q + 1] + {_STEP.format('nraw', 'q').replace('free', 'nfree')}) END AS total FROM costs WHERE pos = n),
bt(run_id, stretch, pos, seg, state) AS (
  SELECT run_id, stretch, pos, seg, list_position(total, list_min(total)) - 1 FROM ends
  UNION ALL
  SELECT run_id, stretch, pos, seg, list_position(total, list_min(total)) - 1
  FROM (SELECT c.run_id, c.stretch, c.pos, c.seg, list_transform({_SPEEDS}, lambda q: c.cost[q + 1] + {_STEP.format('b.state', 'q').replace('free', 'x.free')}) AS total
        FROM bt b JOIN costs c ON c.run_id = b.run_id AND c.stretch = b.stretch AND c.pos = b.pos - 1
                  JOIN st x ON x.run_id = b.run_id AND x.stretch = b.stretch AND x.pos = b.pos)),
co AS (
  SELECT s0.*, CAST(CASE WHEN b.state IS NOT NULL AND (raw IS NULL OR abs(b.state - raw) > 3) THEN b.state ELSE raw END AS INTEGER) AS corr FROM s0 LEFT JOIN bt b USING (run_id, seg)),
sp AS (
  SELECT *, median(corr) OVER x AS ml, median(corr) OVER y AS mr, count(corr) OVER x AS cl, count(corr) OVER y AS cr, list(corr) OVER x AS la, list(corr) OVER y AS lb
  FROM co WINDOW x AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), y AS (PARTITION BY run_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
tg AS (SELECT *, corr - ml AS dl, corr - mr AS dr, CAST(round_even(CASE WHEN abs(corr - ml) >= abs(corr - mr) THEN ml ELSE mr END, 0) AS INTEGER) AS target FROM sp),
rep AS MATERIALIZED (
  SELECT *, CASE WHEN raw IS NOT NULL AND len = 1 AND corr = raw AND cl >= 2 AND cr >= 2 AND dl * dr > 0 AND greatest(abs(dl), abs(dr)) >= 2
                      AND NOT list_contains(list_concat(la, lb), corr) AND abs(target - corr) >= 2 THEN target ELSE corr END AS final FROM tg)"""

CONFIDENCE_WITH_ISLANDS = f"WITH RECURSIVE {SCORE_SQL} SELECT run_id, seg, round(conf, 6) AS conf, ok AS anchor, round(line, 6) AS fill FROM line"
REPAIR_CHAIN = f"WITH RECURSIVE {REPAIR_SQL} SELECT run_id, seg, raw, corr, final FROM rep"
REPAIR_LOG = f"""WITH RECURSIVE {REPAIR_SQL},
fr AS (
  SELECT run_id, CAST(sum(len) OVER (PARTITION BY run_id ORDER BY seg) - len AS INTEGER) AS first, len, coalesce(final, -1) AS speed,
         CASE WHEN raw IS NULL THEN 12 WHEN final IS NOT NULL AND final <> raw THEN 11 WHEN conf >= 20 THEN 21 ELSE 0 END AS flag FROM rep),
ex AS (SELECT run_id, first + CAST(unnest(range(len)) AS INTEGER) AS frame, speed, flag FROM fr),
sd AS (SELECT *, CASE WHEN speed >= 0 THEN coalesce(lag(speed) OVER w / 3.6 * (frame - lag(frame) OVER w) / 30.0, 0) ELSE 0 END AS step FROM ex WINDOW w AS (PARTITION BY run_id ORDER BY frame))
SELECT run_id, frame, round(sum(step) OVER (PARTITION BY run_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 2) AS dist, speed, flag FROM sd"""
REPAIR_FUNNEL = f"""WITH RECURSIVE {REPAIR_SQL},
e AS (
  SELECT run_id, abs(raw - truth) > 1 AS re, final IS NULL OR abs(final - truth) > 1 AS fe, final IS NOT NULL AND final <> raw AS ch FROM rep WHERE raw IS NOT NULL AND truth IS NOT NULL)
SELECT run_id, count(*) AS seg, count(*) FILTER (re) AS raw, count(*) FILTER (re AND ch AND NOT fe) AS fix, count(*) FILTER (re AND ch AND fe) AS fix_wrong,
       count(*) FILTER (re AND NOT ch) AS missed, count(*) FILTER (NOT re AND ch AND fe) AS harm, count(*) FILTER (fe) AS final
FROM e GROUP BY ROLLUP (run_id)"""

#: Greedy sections of the readings r, walked row by row: table sec.
_SECTIONS = """,
ac AS MATERIALIZED (
  SELECT *, (raw - lag(raw) OVER w) / CASE WHEN mid - lag(mid) OVER w <= 0 THEN 1 / 30.0::DOUBLE ELSE (mid - lag(mid) OVER w) / 30.0::DOUBLE END AS accel
  FROM r WINDOW w AS (PARTITION BY run_id ORDER BY seg)),
wk(run_id, seg, b, low, high, l, r) AS (
  SELECT run_id, seg, seg, NULL::DOUBLE, NULL::DOUBLE, NULL::INTEGER, NULL::INTEGER FROM ac WHERE seg = 0
  UNION ALL
  SELECT run_id, seg,
         CASE WHEN accel IS NULL THEN seg WHEN cut THEN seg - 1 ELSE b END,
         CASE WHEN accel IS NULL THEN NULL WHEN cut OR low IS NULL THEN accel ELSE least(low, accel) END,
         CASE WHEN accel IS NULL THEN NULL WHEN cut OR low IS NULL THEN accel ELSE greatest(high, accel) END,
         CASE WHEN cut THEN b END, CASE WHEN cut THEN seg - 1 END
  FROM (SELECT w.run_id, x.seg, w.b, w.low, w.high, x.accel, w.low IS NOT NULL AND (x.accel IS NULL OR greatest(w.high, x.accel) - least(w.low, x.accel) > 8) AS cut
        FROM wk w JOIN ac x ON x.run_id = w.run_id AND x.seg = w.seg + 1)),
sec AS MATERIALIZED (
  SELECT run_id, l, r FROM wk WHERE l IS NOT NULL
  UNION ALL
  SELECT run_id, b, seg FROM wk w WHERE low IS NOT NULL AND seg = (SELECT max(seg) FROM ac WHERE ac.run_id = w.run_id))"""
_TRUSTED = """,
tr AS MATERIALIZED (
  SELECT s.run_id, s.l, s.r, avg(x.accel) FILTER (x.seg > s.l) AS accel, sum(x.len) AS frames, arg_min(x.raw, x.seg)::DOUBLE AS v0, min(x.mid) / 30.0::DOUBLE AS t0, max(x.mid) / 30.0::DOUBLE AS t1
  FROM sec s JOIN ac x ON x.run_id = s.run_id AND x.seg BETWEEN s.l AND s.r GROUP BY ALL HAVING sum(x.len) >= 4 AND abs(avg(x.accel) FILTER (x.seg > s.l)) <= 180)"""

ACCELERATION_SECTIONS = f"WITH RECURSIVE {READINGS_SQL}{_SECTIONS} SELECT run_id, l, r FROM sec"
SECTION_TOTALS = f"WITH RECURSIVE {READINGS_SQL}{_SECTIONS}{_TRUSTED} SELECT run_id, count(*) AS n, CAST(sum(r - l) AS BIGINT) AS pairs, round(avg(accel), 6) AS accel FROM tr GROUP BY run_id"

REBUILT_CURVE = f"""WITH RECURSIVE {CONFIDENCE_SQL}{_SECTIONS}{_TRUSTED},
m AS MATERIALIZED (SELECT run_id, seg, mid / 30.0::DOUBLE AS t, raw, raw IS NOT NULL AND conf0 >= 20 AND NOT (conf0 < 50 AND coalesce(jerk BETWEEN 5 AND 40, false)) AS anchor FROM k),
x AS (
  SELECT m.*, (SELECT arg_max(tr, l * 1000000 + r) FROM tr WHERE tr.run_id = m.run_id AND tr.l <= m.seg) AS a,
         (SELECT arg_min(tr, l * 1000000 - r) FROM tr WHERE tr.run_id = m.run_id AND tr.l > m.seg) AS b FROM m),
y AS (
  SELECT *, a.v0 + a.accel * (t - a.t0) AS va, b.v0 + b.accel * (t - b.t0) AS vb, b.t0 - a.t1 AS gap,
         CASE WHEN abs(a.accel - b.accel) > 1e-9 THEN (b.v0 - a.v0 + a.accel * a.t0 - b.accel * b.t0) / (a.accel - b.accel) END AS meet FROM x),
z AS (
  SELECT *, CASE WHEN a IS NOT NULL AND seg <= a.r THEN va
                 WHEN a IS NOT NULL AND b IS NOT NULL THEN
                   CASE WHEN meet BETWEEN a.t1 AND b.t0 THEN CASE WHEN t <= meet THEN va ELSE vb END
                        ELSE (1 - CASE WHEN gap > 1e-9 THEN (t - a.t1) / gap ELSE 0.5 END) * va + CASE WHEN gap > 1e-9 THEN (t - a.t1) / gap ELSE 0.5 END * vb END
                 WHEN a IS NOT NULL THEN va WHEN b IS NOT NULL THEN vb END AS v FROM y),
c2 AS (SELECT *, CASE WHEN v IS NOT NULL THEN least(greatest(v, 0.0), 400.0) END AS rebuilt FROM z)
SELECT run_id, seg, round(rebuilt, 6) AS rebuilt,
       CASE WHEN NOT anchor AND rebuilt IS NOT NULL AND (raw IS NULL OR abs(raw - round_even(rebuilt, 0)) > 5) THEN CAST(round_even(rebuilt, 0) AS INTEGER) ELSE raw END AS patched FROM c2"""

#: Query name to SQL.
ORACLES = {
    "confidence_with_islands": CONFIDENCE_WITH_ISLANDS,
    "repair_chain": REPAIR_CHAIN,
    "repair_log": REPAIR_LOG,
    "repair_funnel": REPAIR_FUNNEL,
    "acceleration_sections": ACCELERATION_SECTIONS,
    "rebuilt_curve": REBUILT_CURVE,
    "section_totals": SECTION_TOTALS,
}
