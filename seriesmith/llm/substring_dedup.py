"""Substring dedup: words that lie in a window which an earlier document also has.

Suffix automata of reference shards: documents are streamed through them for matching statistics,
and spans of a window or more are removed. ``remove_reference_spans`` broadcasts the automata's words
where the reference has a proven bound. ``substring_dedup`` compares a corpus with itself, where the
reference grows with the corpus and cannot be broadcast: its shards are dealt to tasks, cut so that
only words that can match meet.

1. Every window has a minimizer, the least hash of its 10-word runs, and equal windows have equal
   ones. A document's windows fall into stretches with one minimizer, about 21 windows each. One
   pass writes (minimizer, 128 bits of the stretch's words) for each stretch: one row per 21 words.
2. A stretch whose words are also a stretch of an earlier document is removed whole. Where one
   minimizer has several different stretches (the edges of repeated passages), the words of each are
   sent, from its first document, to the minimizer's shard. There they go through the shard's
   automaton in the order of documents, each matched against all earlier ones and then added.
3. A minimizer with more stretches, or more words in them, than one task should hold is matched by hashes of its windows
   instead, which spread over tasks and are aggregated on the map side.
4. A last pass over the texts removes the words and counts.

Joins have partitions that adaptive execution can split. Texts are equal where 128 bits of them are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import join_dealt, join_shuffled, materialize, read_table
from seriesmith.llm.unit_cache import newest_per_worker

WINDOW = 50
#: Words of the runs among whose hashes a window's minimizer is chosen.
RUN = 10
#: Stretches of one minimizer that a task matches by an automaton, and words of a usual one; longer ones count by their words.
SHARD_STRETCHES = 2000
STRETCH_WORDS = 70
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Windows:
    """Hashes of the windows of one document, and the stretches of windows with one minimizer."""

    def __init__(self, words: list[bytes], window: int = WINDOW, run: int = RUN):
        self.window, n = window, len(words)
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=n)
        with np.errstate(over="ignore"):
            self.sums, self.back = [], []
            for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES)):
                each = _mixed(h + np.uint64(k))
                power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
                self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(each * power[:n], dtype=np.uint64)]))
                self.back.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64))
            every = np.arange(n - run + 1)
            low = _mixed(self._hash(0, every, every + run))
            span, width = window - run + 1, 1
            while width * 2 <= span:
                low, width = np.minimum(low[:-width], low[width:]), width * 2
            if width < span:
                low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
            cut = np.flatnonzero(low[1:] != low[:-1]) + 1
            #: Stretches: windows begin at first .. last - 1.
            self.first, self.last = np.concatenate([[0], cut]), np.concatenate([cut, [len(low)]])
            self.minimizer = low[self.first].view(np.int64)
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        begin, end = (ends - size)[self.first].tolist(), ends[self.last + window - 2].tolist()
        sums = np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(begin, end)]), ">i8").astype(np.int64).reshape(-1, 2)
        #: 128 bits of a stretch's words.
        self.stretch, self.check = sums[:, 0], sums[:, 1]

    def _hash(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[k][b] - self.sums[k][a]) * self.back[k][a]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return tuple(_mixed(self._hash(k, at, at + self.window)).view(np.int64) for k in range(2))

    def starts(self, of: np.ndarray) -> np.ndarray:
        """First words of the windows in the stretches chosen by the mask ``of``."""
        return np.concatenate([np.arange(0), *[np.arange(a, b) for a, b in zip(self.first[of], self.last[of])]])


def _stretches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m, s, t, size = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or b"").split()
                if len(words) >= window:
                    w = Windows(words, window)
                    at = np.unique(w.stretch, return_index=True)[1]
                    rows.append(np.full(len(at), i))
                    m.append(w.minimizer[at])
                    s.append(w.stretch[at])
                    t.append(w.check[at])
                    size.append((w.last - w.first)[at] + window - 1)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(x)) for x in (m, s, t)), pa.array(np.concatenate(size), pa.int32())],
                    ["doc_id", "m", "s", "t", "size"],
                )

    return run


def _segment_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "m", "s", "crowded", "words"]
        for batch in batches:
            rows, m, s, crowded, held = [], [], [], [], []
            for i, (text, few, many) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3))):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                w = Windows(words, window)
                for keys, much in ((few, False), (many, True)):
                    found = np.flatnonzero(np.isin(w.stretch, keys.values.to_numpy(zero_copy_only=False)))
                    for k in found[np.unique(w.stretch[found], return_index=True)[1]]:
                        rows.append(i)
                        m.append(int(w.minimizer[k]))
                        s.append(int(w.stretch[k]))
                        crowded.append(much)
                        held.append(b" ".join(words[w.first[k] : w.last[k] + window - 1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(m, pa.int64()), pa.array(s, pa.int64()), pa.array(crowded, pa.bool_()), pa.array(held, pa.binary())], names
            )

    return run


def _automaton_matches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by shard and document; one shard's automaton is held at a time."""
        shard, automaton, doc, waiting = None, None, None, []
        for batch in batches:
            rows, keys, offsets = [], [], []
            for i, (doc_id, m, s, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                words = text.split(b" ")
                if automaton is None or m != shard:
                    shard, automaton, doc, waiting = m, SuffixAutomaton(), doc_id, []
                if doc_id != doc:  # what one document has does not count against itself
                    for held in waiting:
                        automaton.add(held)
                    doc, waiting = doc_id, []
                waiting.append(words)
                at = [k - window + 1 for k, n in enumerate(automaton.matching_statistics(words)) if n >= window]
                if at:
                    rows.append(i)
                    keys.append(s)
                    offsets.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(offsets, pa.list_(pa.int32()))], ["doc_id", "s", "at"]
            )

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = text.split(b" ")
                every = np.arange(len(words) - window + 1)
                a, b = Windows(words, window).hashes(every)
                rows.append(np.full(len(every), i))
                at.append(every)
                one.append(a)
                two.append(b)
            doc, s = (batch.column(k).take(pa.array(np.concatenate(rows))) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([doc, s, *(pa.array(np.concatenate(x)) for x in (at, one, two))], ["doc_id", "s", "at", "a", "b"])

    return run


def _cover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, whole, partial in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = (text or b"").split()
                n = len(words)
                keep = words
                if n >= window and (whole.is_valid or partial.is_valid):
                    w = Windows(words, window)
                    flag = np.zeros(n - window + 1, dtype=bool)
                    if whole.is_valid:
                        flag[w.starts(np.isin(w.stretch, whole.values.to_numpy(zero_copy_only=False)))] = True
                    order = np.argsort(w.stretch, kind="stable")
                    for part in partial.as_py() or ():
                        a, b = (np.searchsorted(w.stretch, part["s"], side, order) for side in ("left", "right"))
                        for first in w.first[order[a:b]]:
                            flag[first + np.array(part["at"])] = True
                    at = np.flatnonzero(flag)
                    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
                    keep = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
                total.append(n)
                removed.append(n - len(keep))
                kept.append(b" ".join(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD_STRETCHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if it lies in a window of ``window`` consecutive words whose sequence also starts in
    a document with a smaller id. Windows are judged on the input. ``shard`` is the number of usual
    stretches up to which a minimizer is matched by an automaton. Words are what ASCII white space
    separates. A null text has no words; shorter documents than a window keep all. A row with a null
    id neither removes words nor loses any. Rows that repeat an id are one document for the order.
    Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = materialize(texts.mapInArrow(_stretches(window), f"doc_id {id_type}, m long, s long, t long, size int").where("doc_id is not null"), "stretches")
    first = rows.groupBy("m", "s", "t").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("g"), F.max("size").alias("size"))
    whole = join_dealt(rows.drop("size"), first.where("f < g").select("m", "s", "t", "f"), ["m", "s", "t"]).where("doc_id > f").groupBy("doc_id").agg(F.collect_set("s").alias("whole"))
    several = first.groupBy("m").agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")).where("lo < hi")
    several = several.select("m", ((F.col("n") > shard) | (F.col("held") > shard * STRETCH_WORDS)).alias("crowded"))
    keys = lambda c: F.collect_set(F.when(c, F.col("s")))
    wanted = join_dealt(first.drop("size"), several, ["m"]).groupBy(F.col("f").alias("doc_id")).agg(keys(~F.col("crowded")).alias("few"), keys(F.col("crowded")).alias("many"))
    segments = materialize(join_shuffled(texts, wanted, ["doc_id"]).mapInArrow(_segment_rows(window), f"doc_id {id_type}, m long, s long, crowded boolean, words binary"), "segments")
    dealt = segments.where("not crowded").select("doc_id", "m", "s", "words").repartition("m").sortWithinPartitions("m", "doc_id")
    matched = dealt.mapInArrow(_automaton_matches(window), f"doc_id {id_type}, s long, at array<int>")
    windows = segments.where("crowded").select("doc_id", "s", "words").mapInArrow(_window_rows(window), f"doc_id {id_type}, s long, at long, a long, b long")
    seen = windows.groupBy("a", "b").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("g")).where("f < g").select("a", "b", "f")
    hashed = join_dealt(windows, seen, ["a", "b"]).where("doc_id > f").groupBy("doc_id", "s").agg(F.collect_set(F.col("at").cast("int")).alias("at"))
    partial = matched.unionByName(hashed).groupBy("doc_id").agg(F.collect_list(F.struct("s", "at")).alias("partial"))
    flagged = whole.join(partial, "doc_id", "full")
    return join_shuffled(texts, flagged, ["doc_id"], "left").mapInArrow(_cover(window), f"doc_id {id_type}, n_words long, n_removed long, kept_text string")


class SuffixAutomaton:
    """Suffix automaton over the words of documents, which may come one by one; matches never cross from one to the next."""

    def __init__(self, documents: list[list[bytes]] = ()):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for words in documents:
            self.add(words)

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _new(self, length: int, step: dict, link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.step[last].get(word)
        if q is not None:  # another document went this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        now = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = now
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return now

    def matching_statistics(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest sequence ending there that a document contains."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            nxt = self.step[state].get(word)
            state, length = (0, 0) if nxt is None else (nxt, length + 1)
            out.append(length)
        return out


#: Words that one broadcast automaton may hold: about 1 kB each in memory.
SHARD_WORDS = 200_000
#: Words of reference that are broadcast at all; each worker holds their automata, some 0.5 GB.
REFERENCE_WORDS = 500_000


def remove_reference_spans(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove from documents every span of ``window`` words or more that a reference text contains.

    For a reference with a proven bound, such as a benchmark: beyond REFERENCE_WORDS it raises
    ValueError. Its texts are cut into shards of whole texts; each task builds the automata from the
    broadcast words and streams its documents through all of them.

    Returns doc_id, n_words, n_removed, kept_text; nulls count as empty texts.
    """
    from seriesmith.llm.common import count_words

    size = reference.agg(F.coalesce(F.sum(count_words(F.col(reference_col))), F.lit(0)).alias("n")).first()["n"]
    if size > REFERENCE_WORDS:
        raise ValueError(f"the reference has {size} words; at most {REFERENCE_WORDS} are broadcast")
    texts = [(r[0] or "").encode().split() for r in reference.select(reference_col).distinct().collect()]
    held = docs.sparkSession.sparkContext.broadcast(texts)
    id_type = docs.schema[id_col].dataType.simpleString()

    shard_words, name = SHARD_WORDS, uuid.uuid4().hex

    def automata() -> list[SuffixAutomaton]:
        shards, some, n = [], [], 0
        for words in held.value:
            some.append(words)
            n += len(words)
            if n >= shard_words:
                shards.append(SuffixAutomaton(some))
                some, n = [], 0
        return [*shards, SuffixAutomaton(some)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = newest_per_worker("reference", name, automata)  # built once a worker
        for batch in batches:
            total, removed, kept = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                longest = [max(x) for x in zip(*[s.matching_statistics(words) for s in shards])]
                keep, reach = [], len(words)
                for k in range(len(words) - 1, -1, -1):
                    if longest[k] >= window:
                        reach = min(reach, k - longest[k] + 1)
                    if k < reach:
                        keep.append(words[k])
                        reach = len(words) if reach > k else reach
                total.append(len(words))
                removed.append(len(words) - len(keep))
                kept.append(b" ".join(reversed(keep)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark, sf_dir) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
