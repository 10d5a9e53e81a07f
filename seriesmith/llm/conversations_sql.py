"""The repair of damaged conversations as DuckDB SQL, which the query must agree with.

A state's least (cost, audit) is one string, nine digits of cost before the audit, so that the least
string is the least pair; ``~`` is a state that cannot be reached.
"""

from __future__ import annotations

NO_WAY = "'~'"


def _more(state: str, cost: str | int, edits: str, where: str = "true") -> str:
    return f"CASE WHEN {state} <> {NO_WAY} AND {where} THEN lpad(CAST(CAST(substr({state}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{edits}' ELSE {NO_WAY} END"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


#: Insertions after states 0 (nothing yet), 1 (system), 2 (user), 3 (assistant).
_CLOSED = f"s0, s1, {_least('s2', _more('s0', 2, 'I'), _more('s1', 2, 'I'), _more('s3', 2, 'I'))} AS s2, {_least('s3', _more('s2', 2, 'I'), _more('s0', 4, 'II'), _more('s1', 4, 'II'))} AS s3"
_STAYS, _CUT = "fault NOT IN (1, 2)", "CAST(fault = 3 AS INTEGER)"


def _to(state: int, sources: tuple[int, ...], initial: str) -> str:
    ways = [_more(f"s{state}", 3, "D")]
    for x in sources:
        ways.append(_more(f"s{x}", _CUT, "K", f"{_STAYS} AND initial = '{initial}'"))
        if initial != "s":
            ways.append(_more(f"s{x}", f"2 + {_CUT}", "R", _STAYS))
    return _least(*ways) if len(ways) > 1 else ways[0]


_TURN = f"{_more('s0', 3, 'D')}, {_to(1, (0,), 's')}, {_to(2, (0, 1, 3), 'u')}, {_to(3, (2,), 'a')}"

ORACLE = f"""
WITH RECURSIVE e(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM e WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM e WHERE k = 8),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n FROM damaged),
faulty AS (
  SELECT conv_id, turn, role, text, n, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
         substr(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1, 1) || substr(role, 1, 1) AS pair
  FROM placed),
d(conv_id, n, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', {NO_WAY}, {NO_WAY}, {NO_WAY} FROM faulty
  UNION ALL
  SELECT c.conv_id, f.n, {_TURN}
  FROM (SELECT conv_id, n, {_CLOSED} FROM d) c JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.n = c.n + 1),
last AS (
  SELECT conv_id, least(s0, s3) AS best
  FROM (SELECT conv_id, n, {_CLOSED} FROM (SELECT * FROM d QUALIFY n = max(n) OVER (PARTITION BY conv_id)))),
solved AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM last),
edits AS (
  SELECT conv_id, k, edit, sum(CAST(edit <> 'I' AS INTEGER)) OVER w AS n, sum(CAST(edit <> 'D' AS INTEGER)) OVER w AS place
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS k FROM solved WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (
  SELECT e.conv_id, e.k, e.place, e.edit, f.role, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text,
         max(CAST(e.edit = 'K' AND f.initial = 's' AS INTEGER)) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = e.n
  WHERE e.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole
  FROM said GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""
