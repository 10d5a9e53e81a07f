"""Toxicity: a counterfactually regularised classifier over whole texts.

A logistic model over which words, and beginnings of words, a text has is fitted by proximal gradient with an L1 penalty, so
that few words count and long texts do not drift. Identity terms always have a place in the model,
free of that penalty and of either sign. Labelled texts are copied with their labels, an identity term
swapped for another of its kind or one put in, and sentences of the labelled texts are varied in the
same way; the squared change of the score is penalised, so that a neutral mention of a group does not
make a text toxic. Every pair of sentences differs in an identity term, so the penalty acts on each.

The fit sees a bounded sample of labelled rows, whole texts of any length; words are taken out on the
executors. Scoring is one Arrow batch function with the few words that have weight.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import materialize, read_table

#: Labelled rows that are fitted, chosen by the least hash of their id.
SAMPLE_ROWS = 6000
#: A word must be in this many of the fitted texts.
LEAST_TEXTS = 8
#: A word can only speak for toxicity if its share of toxic texts is this many times that of all texts.
LEAST_LIFT = 1.5
#: Weights of the penalties: L1 while words are chosen, L2 after that, and the mean squared change
#: between counterfactual sentences.
L1 = 0.002
L2 = 0.00001
COUNTERFACTUAL = 1.0
#: Weight of the squares of the identity terms' weights.
L2_TERMS = 0.001
STEPS = 120
THRESHOLD = 0.7
SEED = 11

#: Fixed terms by kind; terms of one kind are swapped for each other.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "african", "arab", "latino", "european", "indigenous"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("musulman", "chrétien", "juif", "athée", "bouddhiste"),
    ("muslimisch", "christlich", "jüdisch", "buddhistisch"),
    ("musulmán", "cristiano", "judío", "budista", "ateo"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(words: Iterable[str]) -> set[str]:
    """The words, and the beginnings of longer ones, so that inflected forms count together."""
    words = set(words)
    longer = [w for w in words if len(w) > 5]
    return words | {w[:4] + "*" for w in longer} | {w[:5] + "*" for w in longer}


def words_of(text: str) -> set[str]:
    """Features of the lower-cased runs of letters of a text."""
    return features_of(_WORD.findall(text.lower()))


KIND_OF = {t: kind for kind in IDENTITY_TERMS for t in kind}
#: Features of the identity terms, which are always in the model.
TERM_FEATURES = frozenset(f for t in KIND_OF for f in features_of([t]))


class ToxicModel:
    """``touched``: share of the counterfactual pairs whose difference meets a weight."""

    def __init__(self, bias: float, weights: dict[str, float], touched: float = 0.0):
        self.bias, self.weights, self.touched = bias, weights, touched

    def score(self, text: str) -> float:
        weights = self.weights
        z = self.bias + sum(sorted(weights[w] for w in weights.keys() & words_of(text)))
        return float(1 / (1 + np.exp(-z)))


def _other(rng: random.Random, term: str) -> str:
    return rng.choice([t for t in KIND_OF[term] if t != term])


#: Features that only the one and only the other of two word sets have.
Pair = tuple[frozenset[str], frozenset[str]]


def variants(sentence: list[str], seed: int = SEED) -> list[Pair]:
    """Pairs of word sets that a fair score does not tell apart, as their differences.

    An identity term is swapped for another one of its kind, and left out; into a sentence without
    one, two of a kind are put in. Which ones follows from the sentence alone.
    """
    if not sentence:
        return []
    rng = random.Random(zlib.crc32(" ".join(sentence).encode()) ^ seed)
    terms = [k for k, w in enumerate(sentence) if w in KIND_OF]
    own = features_of(sentence)
    if terms:
        at = rng.choice(terms)
        rest = [*sentence[:at], *sentence[at + 1 :]]
        sets = [(own, features_of([*rest, _other(rng, sentence[at])])), (own, features_of(rest))]
    else:
        a, b = rng.sample(rng.choice(IDENTITY_TERMS), 2)
        sets = [(own | features_of([a]), own | features_of([b])), (own, own | features_of([a]))]
    return [(frozenset(x - y), frozenset(y - x)) for x, y in sets]


def _written(pair: Pair) -> str:
    return " ".join(sorted(pair[0])) + "|" + " ".join(sorted(pair[1]))


def _read(text: str) -> Pair:
    return tuple(frozenset(side.split()) for side in text.split("|"))


def _copies(word_sets: list[set[str]], seed: int) -> list[set[str]]:
    """Every text once more: identity terms swapped, or one put in where there is none."""
    rng = random.Random(seed + 1)
    out = []
    for words in word_sets:
        terms = sorted(w for w in words if w in KIND_OF)
        swapped = {t: _other(rng, t) for t in terms} or {None: rng.choice(sorted(KIND_OF))}
        gone = {f for t in terms for f in features_of([t])}
        out.append((words - gone) | features_of(swapped.values()))
    return out


def fit(
    word_sets: list[set[str]],
    labels: list[int],
    sentences: list[list[str]] | dict[Pair, int] = (),
    counterfactual: float = COUNTERFACTUAL,
    l1: float = L1,
    least_texts: int = LEAST_TEXTS,
    steps: int = STEPS,
    seed: int = SEED,
) -> ToxicModel:
    """Fit on feature sets with labels 0 or 1. Without rows of both labels the score is one constant.

    ``sentences`` are varied, or are counts of pairs that ``variants`` made.
    """
    y = np.array(labels, float)
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return ToxicModel(bias, {})
    often = Counter(w for s in word_sets for w in s)
    vocabulary = sorted(TERM_FEATURES.union(w for w, k in often.items() if k >= least_texts))
    word_sets, y = [*word_sets, *_copies(word_sets, seed)], np.array([*labels, *labels], float)
    n = len(y)
    index = {w: k for k, w in enumerate(vocabulary)}
    rows = np.repeat(np.arange(n), [len(s) for s in word_sets])
    free = np.array([w in TERM_FEATURES for w in vocabulary])
    cols = np.fromiter((index.get(w, -1) for s in word_sets for w in sorted(s)), int, len(rows))
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    # each pair is the difference of two word sets: +1 and -1 at the words that only one has; equal ones are counted
    counted = sentences if isinstance(sentences, dict) else Counter(pair for s in sentences for pair in variants(list(s), seed))
    pairs = sorted(counted.items(), key=lambda x: _written(x[0]))
    often = np.array([k for _, k in pairs], float)
    pair_rows, pair_cols, pair_signs = [], [], []
    for k, ((one, other), _) in enumerate(pairs):
        for only, sign in ((one, 1.0), (other, -1.0)):
            for w in sorted(only):
                if w in index:
                    pair_rows.append(k)
                    pair_cols.append(index[w])
                    pair_signs.append(sign)
    pr, pc, ps = np.array(pair_rows, int), np.array(pair_cols, int), np.array(pair_signs)
    d = len(vocabulary)
    lasso, bias = _descend(rows, cols, y, (pr, pc, ps, often), d, bias, counterfactual, l1, 0.0, steps, free)
    # the penalty that chose the words also shrank them: fit those again with a light one
    chosen = np.flatnonzero((np.abs(lasso) > 1e-6) | free)
    place = np.full(d, -1)
    place[chosen] = np.arange(len(chosen))
    some = place[cols] >= 0
    there = place[pc] >= 0
    kept = (pr[there], place[pc[there]], ps[there], often)
    w, bias = _descend(rows[some], place[cols[some]], y, kept, len(chosen), bias, counterfactual, 0.0, L2, 5 * steps, free[chosen])
    touched = float(often[np.unique(pr[there][w[kept[1]] != 0])].sum() / max(1.0, often.sum()))
    return ToxicModel(bias, {vocabulary[k]: float(v) for k, v in zip(chosen, w) if v}, touched)


def _descend(rows, cols, y, pairs, d, bias, counterfactual, l1, l2, steps, free) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; rows and cols say which text has which word, free which are identity terms."""
    pr, pc, ps, often = pairs
    n_pairs = often.sum()
    l1, l2 = np.where(free, 0.0, l1), np.where(free, L2_TERMS, l2)
    least = np.where(free, -np.inf, 0.0)  # no other word makes a text less toxic
    n = len(y)
    # both labels weigh the same in all, else the rarer one is given up in doubt
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    # step lengths by word: curvature is at most a quarter of a word's share of the texts, times how many words move together
    together = max(1.0, float(np.bincount(rows, minlength=n).max()) ** 0.5) if len(rows) else 1.0
    curve = 0.25 * np.bincount(cols, weight[rows], d) / n * together + l2 + 1e-6
    if len(pr):
        curve += 4 * counterfactual * np.bincount(pc, often[pr], d) / n_pairs
    w, ahead, pace = np.zeros(d), np.zeros(d), 1.0
    best, held, held_bias = np.inf, w, bias
    for _ in range(steps):
        z = np.bincount(rows, ahead[cols], n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        off = weight * (p - y)
        gradient = np.bincount(cols, off[rows], d) / n + l2 * ahead
        loss = float((weight * (np.logaddexp(0, z) - y * z)).mean() + (l1 * np.abs(ahead)).sum() + (l2 / 2 * ahead**2).sum())
        if len(pr):
            change = np.bincount(pr, ps * ahead[pc], len(often))
            gradient += 2 * counterfactual * np.bincount(pc, ps * (often * change)[pr], d) / n_pairs
            loss += counterfactual * float((often * change**2).sum() / n_pairs)
        if loss < best:
            best, held, held_bias = loss, ahead, bias
        elif loss > best + 0.1 * abs(best):  # went too far: start again from the best, slower
            w, ahead, bias, pace, curve = held, held, held_bias, 1.0, curve * 1.5
            continue
        new = ahead - gradient / curve
        new = np.maximum(new - l1 / curve, least)
        bias -= float(off.mean())
        step = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        w, ahead, pace = new, np.maximum(new + (pace - 1) / step * (new - w), least), step
    return held, held_bias


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> ToxicModel:
    """Fit on the labelled rows that are not held out, at most ``sample_rows`` of them.

    Rows without a label, and labels without a text, are left out. Ids may be of any type; where one
    comes with several texts or labels, each pair is a row of its own. The sample is the rows of least
    hash. Its features are counted in Spark; the driver gets those that are in toxic texts more often
    than others, the identity terms, for each text which of them it has, and how often
    each difference between two variants of a sentence occurs.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id")).distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.withColumn("h", F.xxhash64("id", "text")).drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text, label in zip(*(batch.column(n).to_pylist() for n in ("h", "text", "label"))):  # row by row: a long text has many words
                text = text.lower()
                pairs = Counter(_written(pair) for s in _SENTENCE.findall(text) for pair in variants(_WORD.findall(s)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h]), pa.array([label], pa.int32()), pa.array([sorted(words_of(text))], pa.list_(pa.string())), pa.array([list(pairs)], pa.list_(pa.string())), pa.array([list(pairs.values())], pa.list_(pa.int64()))],
                    ["h", "label", "words", "pairs", "often"],
                )

    found = materialize(texts.mapInArrow(run, "h long, label int, words array<string>, pairs array<string>, often array<long>"), "toxicity")
    if found.count() > sample_rows:  # ids with several texts
        found = materialize(found.orderBy("h", "label").limit(sample_rows), "toxicity")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    counts = found.select("label", F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    more = counts.where((F.col("n") >= options.get("least_texts", LEAST_TEXTS)) & (F.col("toxic") * size["n"] > F.col("n") * size["toxic"] * LEAST_LIFT))
    vocabulary = TERM_FEATURES.union(r["w"] for r in more.select("w").collect())  # at most what the bounded sample holds

    # every sentence of the sample is varied; equal differences are counted, and there are few: they hold identity terms only
    each = found.select(F.explode(F.arrays_zip("pairs", "often")).alias("p")).groupBy("p.pairs").agg(F.sum("p.often").alias("often"))
    pairs = {_read(r["pairs"]): r["often"] for r in each.collect()}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[w for w in words if w in vocabulary] for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.string()))], ["h", "label", "words"])

    rows = found.select("h", "label", "words").mapInArrow(keep, "h long, label int, words array<string>").collect()
    rows.sort(key=lambda r: (r["h"], r["label"], r["words"]))
    return fit([set(r["words"]) for r in rows], [r["label"] for r in rows], pairs, **options)


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 at ``threshold`` or more) of every whole text.

    Null and empty texts get the score of no words. A null id is not held out. Other columns are not
    read; rows that repeat are scored alike.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
