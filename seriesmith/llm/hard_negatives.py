"""Hard-negative mining by norm-bucketed search.

Vectors are sorted by norm within their label and packed into buckets, anchors likewise into blocks.
Buckets meet blocks in a join of packed rows; both sides are salted on a grid, so no key is hot and
what is copied is the smaller side, mostly. A pair of packed rows is one matrix product in numpy.

Two searches use it. The first keeps the best rows of an anchor's own label, its positives. Each
positive sets a window of scores for negatives, and the second search keeps the best rows of other
labels in each window. By Cauchy and Schwarz no score exceeds the product of the norms. A pair whose
product is below the lower limits of all windows is left out by the join; in a task buckets come by
falling norm, and a pair is skipped once the product is below the running kth score of every window. Where
all norms are alike, as in normalised embeddings, nothing is skipped, and the work is queries times rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import materialize, read_table

POSITIVES = 5
NEGATIVES = 3
#: A negative scores this share of the positive's score, in hundredths.
LOWEST, HIGHEST = 50, 95
#: Every so many ids are anchors.
ANCHOR_STEP = 50
#: Rows of a bucket of candidates, and of a block of anchors.
BUCKET = 1024
BLOCK = 256
#: Blocks whose running results a task holds; beyond, they are emitted early and merged later.
HELD_BLOCKS = 2048
#: Components beyond this after scaling count as it, and scores are cut to 64 bits.
LARGEST = 1 << 62
#: Up to here products of doubles are exact, and products of 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 2.0**52, 2.0**62
_NONE = np.iinfo(np.int64).min

_PACKED = "label long, most double, dims int, ids array<long>, norms array<double>, flat array<long>, of array<int>, positives array<long>, scores array<long>"


def quantized(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (floor of 256 times each component), norm; without the rows that take no part.

    A null or NaN or infinite component, a null vector, label or id takes no part. Of rows that repeat
    an id the one with the least (label, v) counts.
    """
    id_, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    cut = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * 256)))
    valid = rows.where(id_.isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()).select(
        id_.alias("id"), F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    valid = valid.where(F.forall("v", finite)).withColumn("v", F.transform("v", cut))
    repeated = materialize(valid.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "negatives")
    if not repeated.isEmpty():
        valid = valid.groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.*")
    return valid.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _pack(size: int, windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by label and falling norm."""

        def packed(label, rows):
            dims = max((len(v) for _, _, v, _ in rows), default=0)
            flat = np.zeros((len(rows), dims), np.int64)
            for k, (_, _, v, _) in enumerate(rows):
                flat[k, : len(v)] = v
            wins = [(k, w["id"], w["score"]) for k, (*_, found) in enumerate(rows) for w in found or ()]
            of, ids, scores = zip(*wins) if wins else ((), (), ())
            row = [label, max(n for _, n, *_ in rows), dims, [i for i, *_ in rows], [n for _, n, *_ in rows], flat.ravel(), of, ids, scores]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        types = [pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["label", "most", "dims", "ids", "norms", "flat", "of", "positives", "scores"]
        label, held = None, []
        for batch in batches:
            found = batch.column(4).to_pylist() if windows else [None] * batch.num_rows
            ids, labels, norms = (batch.column(k).to_pylist() for k in (0, 1, 3))
            vectors = batch.column(2)
            for k in range(batch.num_rows):
                if held and (labels[k] != label or len(held) == size):
                    yield packed(label, held)
                    held = []
                label = labels[k]
                held.append((ids[k], norms[k], vectors[k].values.to_numpy(zero_copy_only=False), found[k]))
        if held:
            yield packed(label, held)

    return run


def _packs(rows: DataFrame, size: int, windows: bool = False) -> DataFrame:
    columns = ["id", "label", "v", "norm", *["positives"] * windows]
    dealt = rows.select(*columns).repartitionByRange(F.col("label"), F.desc("norm"), F.col("id")).sortWithinPartitions("label", F.desc("norm"), "id")
    return dealt.mapInArrow(_pack(size, windows), _PACKED)


def _met(blocks: DataFrame, buckets: DataFrame, keys: list[str], condition: Column | None) -> DataFrame:
    """Each block of anchors with each bucket, on a grid of salts: i splits the buckets, j the blocks.

    A block is copied to every i and a bucket to every j. With anchors one row in ANCHOR_STEP, this
    shape of the grid copies least for the number of shuffle partitions.
    """
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = math.ceil(math.sqrt(ANCHOR_STEP * tasks))
    tall = math.ceil(tasks / wide)
    salt = lambda n: F.pmod(F.xxhash64("label", F.col("ids")[0]), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = buckets.select(salt(wide).alias("i"), every(tall).alias("j"), *[F.col(x).alias(f"c_{x}" if x not in keys else x) for x in ("label", "most", "dims", "ids", "flat")])
    a = blocks.select(every(wide).alias("i"), salt(tall).alias("j"), *[F.col(x).alias(f"a_{x}" if x not in keys else x) for x in buckets.columns])
    at = ["i", "j", *keys]
    c = c.repartition(tasks, *at).sortWithinPartitions(*at, F.desc("c_most"))
    out = c.join(a.hint("merge"), at)
    return out if condition is None else out.where(condition)


def _product(a: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """All inner products, exactly; in doubles or 64-bit integers where the norms allow it."""
    m = min(a.shape[1], c.shape[1])
    a, c = a[:, :m], c[:, :m]
    if bound < EXACT_DOUBLE:
        return (a.astype(float) @ c.T.astype(float)).astype(np.int64)
    if bound < EXACT_LONG:
        return a @ c.T
    exact = a.astype(object) @ c.T.astype(object)
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64).reshape(len(a), len(c))


class _Best:
    """The best k (score, id) of each of n searches: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), _NONE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """scores[r, c] is what search which[r] has for ids[c], where allowed."""
        allowed &= scores >= self.kth()[which][:, None]
        if np.count_nonzero(allowed) > 4 * self.k * len(which) and len(ids) > self.k:
            masked = np.where(allowed, scores, _NONE)
            allowed &= scores >= np.partition(masked, len(ids) - self.k, axis=1)[:, len(ids) - self.k][:, None]
        r, c = np.nonzero(allowed)
        if not len(r):
            return
        touched = np.unique(r)
        at = which[touched]
        row = np.concatenate([np.repeat(touched, self.k), r])
        score = np.concatenate([self.scores[at].ravel(), scores[r, c]])
        id_ = np.concatenate([self.ids[at].ravel(), ids[c]])
        order = np.lexsort((id_, -score, row))  # no score is the least integer but that of an empty place
        order = order[np.argsort(score[order] == _NONE, kind="stable")]
        order = order[np.argsort(row[order], kind="stable")]
        row = row[order]
        first = np.searchsorted(row, touched)
        take = order[(first[:, None] + np.arange(self.k))]
        self.scores[at], self.ids[at] = score[take], id_[take]


def _array(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _search(start: Callable, offer: Callable, k: int):
    """Runs over pairs of packed rows; ``start`` and ``offer`` are of one kind of search."""
    names = ["anchor_id", "positive_id", "positive_score", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emit(states):
            for state in states:
                r, c = np.nonzero(state["best"].scores != _NONE)
                some = [state["anchor"][r], state["positive"][r], state["positive_score"][r], state["best"].ids[r, c], state["best"].scores[r, c]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in some], names)

        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for row in range(batch.num_rows):
                ids = _array(col["a_ids"], row)
                key = (ids[0].item(), len(ids))
                if key not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield from emit([held.pop(next(iter(held)))])
                    a = _array(col["a_flat"], row).reshape(len(ids), col["a_dims"][row].as_py())
                    held[key] = {"ids": ids.copy(), "a": a.copy(), "norms": _array(col["a_norms"], row) * (1 + 1e-9)} | start(ids, {n: _array(col[f"a_{n}"], row) for n in ("of", "positives", "scores")}, k)
                state, most = held[key], col["c_most"][row].as_py() * (1 + 1e-9)
                reach = state["norms"] * most
                active = np.flatnonzero(reach[state["of"]] >= np.maximum(state["low"], state["best"].kth()))
                if len(active):
                    c_ids = _array(col["c_ids"], row)
                    c = _array(col["c_flat"], row).reshape(len(c_ids), col["c_dims"][row].as_py())
                    offer(state, active, _product(state["a"], c, reach.max()), c_ids)
        yield from emit(held.values())

    return run


def _start_positives(ids, windows, k):
    n = len(ids)
    return {"anchor": ids.copy(), "positive": np.zeros(n, np.int64), "positive_score": np.zeros(n, np.int64), "of": np.arange(n), "low": np.full(n, _NONE), "best": _Best(n, k)}


def _offer_positives(state, active, scores, ids):
    scores = scores[active]
    state["best"].offer(active, scores, ids, state["ids"][active][:, None] != ids)


def _limits(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers n with LOWEST * s <= 100 n <= HIGHEST * s."""
    exact = scores.astype(object)
    return (-(-exact * LOWEST // 100)).astype(np.int64), (exact * HIGHEST // 100).astype(np.int64)


def _start_negatives(ids, windows, k):
    of = windows["of"].astype(np.int64)
    low, high = _limits(windows["scores"])
    return {"anchor": ids[of], "positive": windows["positives"].copy(), "positive_score": windows["scores"].copy(), "of": of, "low": low, "high": high, "best": _Best(len(of), k)}


def _offer_negatives(state, active, scores, ids):
    scores = scores[state["of"][active]]
    allowed = (scores >= state["low"][active][:, None]) & (scores <= state["high"][active][:, None])
    state["best"].offer(active, scores, ids, allowed)


#: What a search reads of a pair, and what it returns.
_READ = ["a_ids", "a_dims", "a_norms", "a_flat", "a_of", "a_positives", "a_scores", "c_most", "c_dims", "c_ids", "c_flat"]
_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k over all tasks; a search has at most k rows from each."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, all exact.

    See ``quantized`` for what a row is. Anchors have ids divisible by ANCHOR_STEP; a score is the integer
    inner product with the anchor, higher first, ties by smaller id. Its positives are the first rows of
    its label with another id; for each, the first rows of other labels with LOWEST to HIGHEST hundredths of the positive's score. A
    negative positive score has an empty window; zero has zero. Vectors of other lengths are compared over the components that both have.
    Anchors without positives, and positives without negatives, give no rows; neither does an empty
    table. Other columns are not read.
    """
    all_rows = materialize(quantized(rows, id_col, vector_col, label_col), "negatives")
    anchors = all_rows.where(F.col("id") % ANCHOR_STEP == 0)
    buckets = materialize(_packs(all_rows, BUCKET), "negatives")
    met = _met(_packs(anchors, BLOCK), buckets, ["label"], None)
    near = _ranked(met.select(*_READ).mapInArrow(_search(_start_positives, _offer_positives, positives), _FOUND), ["anchor_id"], positives)
    windows = near.where("score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    windowed = materialize(anchors.join(windows, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "norm", "positives"), "negatives")
    blocks = _packs(windowed, BLOCK, windows=True)
    lowest = F.array_min("a_scores") * (LOWEST / 100) * (1 - 1e-9) - 1
    condition = (F.col("a_label") != F.col("c_label")) & (F.col("a_most") * F.col("c_most") * (1 + 1e-9) >= lowest)
    found = _ranked(_met(blocks, buckets, [], condition).select(*_READ).mapInArrow(_search(_start_negatives, _offer_negatives, negatives), _FOUND), ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
