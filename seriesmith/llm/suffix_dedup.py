"""Suffix-array dedup: bytes that lie in a string of 200 bytes which also starts anywhere else.

The suffix array of a whole corpus fits no task, so it is cut into shards within which all equal
strings meet (``suffix_array`` builds a shard's array by induced sorting, and the permuted longest
common prefixes give what each suffix shares with its neighbours).

1. A window of 200 bytes has a minimizer, the least hash of its runs of 32 bytes; equal windows have
   equal ones. The windows of a text fall into stretches with one minimizer, about 85 windows
   each. One pass writes a row a stretch: where it is, its minimizer and a hash of its bytes.
2. Minimizers that occur once are dropped; most do. Equal stretches of a minimizer are counted
   together: where there are several, all their windows are repeated.
3. Where a minimizer has several different stretches, or one that may repeat within itself, the bytes
   of each are sent once to the minimizer's shard. A position whose suffix shares 200 bytes with a
   neighbour in the shard's array starts a repeated string.
4. A minimizer with more bytes than a task should sort has its windows counted by 128-bit hashes.
5. A last pass over the texts removes what repeated strings cover.

Texts are shuffled once; all later passes over them read the same exchange. Stretches are equal where the
64 bits of their minimizer and 64 bits of their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import discard, join_dealt, materialize, read_table
from seriesmith.llm.suffix_array import repeated

WINDOW = 200
#: Bytes of the runs among whose hashes a window's minimizer is chosen.
RUN = 32
#: Windows of a stretch; longer ones are cut.
STRETCH_WINDOWS = 1024
#: Bytes of a text that are looked at together.
BLOCK = 1 << 20
#: Bytes after which a shard is closed, and bytes of one minimizer beyond which its windows are hashed.
SHARD_BYTES = 1 << 20
CROWDED_BYTES = 2 << 20
#: A byte that no UTF-8 text contains, between the stretches of a shard.
_BETWEEN = b"\xff"
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _run_hashes(block: np.ndarray) -> np.ndarray:
    """A hash of the RUN bytes from each position on; equal runs have equal ones."""
    n = len(block) - RUN + 1
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(block, 8)).view(np.uint64).ravel()
    h = eight[:n] * _FACTORS[0]
    for k in range(1, RUN // 8):
        h += eight[8 * k : 8 * k + n] * _FACTORS[k]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(h: np.ndarray, span: int) -> np.ndarray:
    low, width = h, 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    return np.minimum(low[: len(low) - (span - width)], low[span - width :]) if width < span else low


def stretches(text: bytes, window: int = WINDOW, block: int = BLOCK) -> list[np.ndarray]:
    """First window, number of windows, minimizer, and whether windows may repeat inside, of each stretch.

    Every window is in one stretch. Blocks only cut stretches: a long text is looked at piecemeal.
    """
    out, span = [], window - RUN + 1
    for begin in range(0, len(text) - window + 1, block):
        h = _run_hashes(np.frombuffer(text, np.uint8, min(len(text) - begin, block + window - 1), begin))
        low = _sliding_least(h, span)
        n = len(low)
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        last = np.append(first[1:], n)
        # A window repeats in a stretch only if one run with the least hash leaves the windows and a later one enters them.
        leaves, enters = np.flatnonzero(h[:n] == low), np.append(-1, np.flatnonzero(h[span - 1 :] == low) + span - 1)
        leaving, entering = np.searchsorted(leaves, first), np.searchsorted(enters, last + span - 1) - 1
        x, y = np.append(leaves, n)[leaving], enters[entering]
        inside = (x < last) & (y >= first + span - 1) & (x < y)
        pieces = -(-(last - first) // STRETCH_WINDOWS)
        of = np.repeat(np.arange(len(first)), pieces)
        at = first[of] + STRETCH_WINDOWS * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        out.append((at + begin, np.minimum(last[of] - at, STRETCH_WINDOWS), low[at].view(np.int64), inside[of]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]


def _hashes(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, texts)), ">u8").astype(np.uint64).view(np.int64)


def _stretch_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or b""
                if len(text) >= window:
                    at, size, m, inside = stretches(text, window)
                    found.append((at, size, m, _hashes([text[a:b] for a, b in zip(at.tolist(), (at + size + window - 1).tolist())]), inside))
                    rows.append(np.full(len(at), i))
            if rows:
                columns = [np.concatenate(x) for x in zip(*found)]
                types = [pa.int64(), pa.int16(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(x).cast(t) for x, t in zip(columns, types))], ["doc", "at", "size", "m", "s", "inside"])

    return run


def _wanted_bytes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (text, wanted) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                text = text.as_py()
                for w in wanted:
                    rows.append(i)
                    out.append((w["at"], w["m"], w["several"], text[w["at"] : w["at"] + w["size"] + window - 1]))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, types))], ["doc", "at", "m", "several", "bytes"])

    return run


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _shards(window: int, shard_bytes: int):
    """Rows come ordered by minimizer; shards are closed between minimizers."""

    def solved(kind, held):
        texts = [x[3] for x in held]
        flag = repeated(np.frombuffer(_BETWEEN.join(texts), np.uint8), window)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        rows, at, size = [], [], []
        for k, (text, end) in enumerate(zip(texts, ends.tolist())):
            if not held[k][2]:  # one copy only: which of its windows others have, or it has twice
                a, n = _runs(flag[end - len(text) : end - window + 1])
                rows += [k] * len(a)
                at.append(held[k][1] + a)
                size.append(n)
        none = [np.zeros(0, np.int64)]
        docs = pa.array([held[k][0] for k in rows], kind)
        return pa.RecordBatch.from_arrays([docs, pa.array(np.concatenate(none + at)), pa.array(np.concatenate(none + size))], ["doc", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last, kind = [], 0, None, None
        for batch in batches:
            kind = batch.column(0).type
            for doc, at, m, several, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if m != last and n >= shard_bytes:
                    yield solved(kind, held)
                    held, n = [], 0
                last = m
                held.append((doc, at, several, text))
                n += len(text)
        if held:
            yield solved(kind, held)

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, wanted) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                text = text.as_py()
                for w in wanted:
                    at = np.arange(w["at"], w["at"] + w["size"])
                    n = len(at)
                    sums = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[k : k + window]) for k in at.tolist()), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
                    columns = [pa.array(at), pa.array([w["several"]] * n), pa.array(np.ascontiguousarray(sums[:, 0])), pa.array(np.ascontiguousarray(sums[:, 1]))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), *columns], ["doc", "at", "several", "a", "b"])

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column(1), batch.column(2)):
                text = text.as_py() or b""
                spans, keep = 0, text
                if marks.is_valid:
                    at, size = (marks.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                    order = np.argsort(at, kind="stable")
                    at, end = at[order], np.maximum.accumulate((at + size)[order] + window - 1)
                    begins = np.concatenate([[True], at[1:] > end[:-1]])  # spans that touch are one
                    a, b = at[begins].tolist(), end[np.append(begins[1:], True)].tolist()
                    spans, keep = len(a), b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)]))
                out.append((len(text), len(text) - len(keep), spans, keep))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, crowded_bytes: int = CROWDED_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_bytes (binary: characters may be cut).

    A byte of the UTF-8 text goes if it lies in a string of ``window`` bytes that also starts at
    another place of any document or of its own; all copies go. Strings are judged on the input. A null
    text is empty. A shorter text than a window keeps all. Every row is a document, whether its id is
    null, repeated or neither; of rows that repeat as a whole each counts. Other columns are not
    read. No rows give no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    again = not docs.groupBy(id_col).count().where("count > 1").isEmpty()
    text = F.col(text_col).cast("binary")
    # ids that repeat are told apart by their texts
    texts = docs.select(F.struct(F.col(id_col).alias("id"), (F.xxhash64(text) if again else F.lit(0).cast("long")).alias("t")).alias("doc"), text.alias("text"))
    doc = f"doc struct<id: {id_type}, t: bigint>"
    rows = materialize(texts.mapInArrow(_stretch_rows(window), f"{doc}, at long, size short, m long, s long, inside boolean"), "stretches")
    several = rows.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.max("inside").alias("inside")).where("n > 1 or inside").select("m")
    shared = materialize(join_dealt(rows, several, ["m"]), "stretches")
    for path in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        discard(path)
    pieces = materialize(shared.groupBy("m", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at", "size")).alias("one"), F.max("inside").alias("inside")), "stretches")
    held = F.sum(F.col("one.size").cast("long") + window - 1)
    shards = pieces.groupBy("m").agg(F.count(F.lit(1)).alias("different"), held.alias("held"), F.max("inside").alias("inside"))
    shards = materialize(shards.where("different > 1 or inside").select("m", (F.col("held") > crowded_bytes).alias("crowded")), "stretches")
    wanted = join_dealt(pieces.select("m", "one", (F.col("n") > 1).alias("several")), shards, ["m"])

    def read(some: DataFrame, run, columns: str) -> DataFrame:
        """The bytes of stretches, from their texts; every call reads the same exchange of the texts."""
        by_doc = some.groupBy("one.doc").agg(F.collect_list(F.struct("one.at", F.col("one.size").cast("int").alias("size"), "m", "several")).alias("wanted"))
        return texts.join(by_doc.hint("merge"), "doc").mapInArrow(run, f"{doc}, at long, {columns}")

    sent = read(wanted.where("not crowded"), _wanted_bytes(window), "m long, several boolean, bytes binary")
    dealt = sent.repartition("m").sortWithinPartitions("m")
    marks = dealt.mapInArrow(_shards(window, shard_bytes), f"{doc}, at long, size long")
    marks = marks.unionByName(join_dealt(shared, pieces.where("n > 1").select("m", "s"), ["m", "s"]).select("doc", "at", F.col("size").cast("long").alias("size")))
    if not shards.where("crowded").isEmpty():
        windows = read(wanted.where("crowded"), _window_rows(window), "several boolean, a long, b long")
        seen = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
        marks = marks.unionByName(join_dealt(windows.where("not several"), seen, ["a", "b"]).select("doc", "at", F.lit(1).cast("long").alias("size")))
    marks = marks.groupBy("doc").agg(F.collect_list(F.struct("at", "size")).alias("marks"))
    out = texts.join(marks.hint("merge"), "doc", "left").mapInArrow(_removed(window), f"{doc}, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
    return out.select(F.col("doc.id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_bytes")


def op12_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = suffix_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, b, octet_length(b) AS n FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)),
w AS (
  SELECT r, k, array_slice(b, k + 1, k + 200) AS s FROM (SELECT r, b, unnest(range(n - 199)) AS k FROM d WHERE n >= 200)),
again AS (SELECT r, k FROM w SEMI JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) t USING (s)),
begun AS (SELECT r, k, coalesce(k > lag(k) OVER o + 200, true) AS opens FROM again WINDOW o AS (PARTITION BY r ORDER BY k)),
spans AS (
  SELECT r, span, min(k) AS a, max(k) + 200 AS e
  FROM (SELECT r, k, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY k) AS span FROM begun) GROUP BY r, span),
pieces AS (
  SELECT r, a AS place, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS x, a AS y FROM spans
  UNION ALL SELECT d.r, d.n, coalesce(s.e, 0), d.n FROM d LEFT JOIN (SELECT r, max(e) AS e FROM spans GROUP BY r) s ON s.r = d.r),
kept AS (
  SELECT r, list_reduce(list(CASE WHEN y > x THEN array_slice(b, x + 1, y) ELSE encode('') END ORDER BY x, y), lambda p, q: p || q) AS b
  FROM pieces JOIN d USING (r) GROUP BY r),
counted AS (SELECT r, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(kept.b) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN counted USING (r)
"""
