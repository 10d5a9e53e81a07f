"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Features are ancestor tags and names by nearness and the shape of the text. The weights of neighbouring
labels depend on the step between the blocks, so that an aside within an article may interrupt it at
no cost, while blocks of one group keep together.

The field is trained on the driver from labelled pages that a seed lays out; its weights are a few
hundred numbers and travel with the function. Pages are parsed, decoded by Viterbi and joined in
Arrow batches, without a shuffle.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import read_table
from seriesmith.llm.html_blocks import features, leaf_blocks
from seriesmith.llm.html_training import labelled_pages

#: Labelled pages, and the seed that lays them out.
TRAINING_PAGES = 600
TRAINING_SEED = 7
STEPS = 300
L2 = 0.005


#: Steps between neighbouring blocks; each has weights of its own for the pairs of labels.
STEP_KINDS = ("step=same", "step=in", "step=out", "step=across")


class BlockField:
    """Two labels, other (0) and main (1); a weight of label 1 for each feature, and of each pair of neighbours.

    A block's first feature may name its step from the block before, for which ``steps`` adds to ``pairs``.
    """

    def __init__(self, weights: dict[str, float], pairs: list[list[float]], steps: dict[str, list[list[float]]] | None = None):
        self.weights, self.pairs, self.steps = weights, pairs, {}
        for kind, more in (steps or {}).items():
            self.steps[kind] = [[x + y for x, y in zip(*rows)] for rows in zip(pairs, more)]

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The likeliest labels of one page, by Viterbi; a part of a form is never main."""
        get = self.weights.get
        other = main = 0.0
        back = []
        for k, names in enumerate(sequence):
            here = -math.inf if "control" in names else sum(get(x, 0.0) for x in names)
            if k:
                (a, b), (c, d) = self.steps.get(names[0], self.pairs) if names else self.pairs
                from_other, from_main = other + a >= main + c, other + b >= main + d
                back.append((0 if from_other else 1, 0 if from_main else 1))
                other, main = max(other + a, main + c), max(other + b, main + d) + here
            else:
                other, main = 0.0, here
        labels = [int(main > other)] if sequence else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(sequences: list[list[list[str]]], labels: list[list[int]], steps: int = STEPS, l2: float = L2) -> BlockField:
    """Greatest conditional likelihood less an L2 penalty, by Adam; forward and backward over all pages at once."""
    names = {x: k for k, x in enumerate(sorted({x for s in sequences for f in s for x in f}))}
    longest_first = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, labels = [sequences[i] for i in longest_first], [labels[i] for i in longest_first]
    n, length = len(sequences), max(map(len, sequences))
    truth = np.full((length, n), -1)
    # blocks with the same features are scored once
    kinds: dict[tuple, int] = {}
    which = np.zeros((length, n), np.int64)
    step_of = {x: k for k, x in enumerate(STEP_KINDS)}
    moved = np.zeros((length, n), np.int64)
    for i, s in enumerate(sequences):
        truth[: len(s), i] = labels[i]
        which[: len(s), i] = [kinds.setdefault(tuple(f), len(kinds)) for f in s]
        moved[: len(s), i] = [step_of.get(f[0], 0) for f in s]
    of_kind = np.repeat(np.arange(len(kinds)), list(map(len, kinds)))
    column = np.array([names[x] for f in kinds for x in f])

    def by_feature(main: np.ndarray) -> np.ndarray:
        return np.bincount(column, np.bincount(which.ravel(), main.ravel(), len(kinds))[of_kind], len(names))

    there = truth >= 0
    both = there[1:]
    sizes, alive = there.sum(axis=0), there.sum(axis=1)
    w, pairs = np.zeros(len(names)), np.zeros((len(STEP_KINDS), 2, 2))

    def by_pair(a: int, b: int, share: np.ndarray) -> np.ndarray:
        return np.bincount(moved[1:].ravel(), share.ravel(), len(STEP_KINDS))

    seen_w = by_feature((truth == 1).astype(float))
    seen_p = np.stack([np.stack([by_pair(a, b, (both & (truth[:-1] == a) & (truth[1:] == b)).astype(float)) for b in (0, 1)], -1) for a in (0, 1)], 1)
    m, v = np.zeros(len(w) + pairs.size), np.zeros(len(w) + pairs.size)
    for step in range(1, steps + 1):
        main = np.bincount(of_kind, w[column], len(kinds))[which]
        go = pairs[moved]  # length, pages, label before, label
        # each state's sums as plain arrays, of the pages that are as long as that
        ahead, behind = np.zeros((2, length, n)), np.zeros((2, length, n))
        ahead[1, 0] = main[0]
        for t in range(1, length):
            k = alive[t]
            for b in (0, 1):
                ahead[b, t, :k] = np.logaddexp(ahead[0, t - 1, :k] + go[t, :k, 0, b], ahead[1, t - 1, :k] + go[t, :k, 1, b]) + b * main[t, :k]
        total = np.logaddexp(*ahead[:, sizes - 1, np.arange(n)])
        for t in range(length - 2, -1, -1):
            k = alive[t + 1]
            for a in (0, 1):
                behind[a, t, :k] = np.logaddexp(go[t + 1, :k, a, 0] + behind[0, t + 1, :k], go[t + 1, :k, a, 1] + main[t + 1, :k] + behind[1, t + 1, :k])
        one = np.exp(ahead[1] + behind[1] - total) * there
        two = np.stack([np.stack([by_pair(a, b, np.exp(ahead[a, :-1] + go[1:, :, a, b] + b * main[1:] + behind[b, 1:] - total) * both) for b in (0, 1)], -1) for a in (0, 1)], 1)
        gradient = np.concatenate([seen_w - by_feature(one) - l2 * w, (seen_p - two - l2 * pairs).ravel()]) / n
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, pairs = w + move[: len(w)], pairs + move[len(w) :].reshape(pairs.shape)
    return BlockField({x: float(w[k]) for x, k in names.items() if not math.isclose(w[k], 0)}, [[0.0, 0.0], [0.0, 0.0]], dict(zip(STEP_KINDS, pairs.tolist())))


@functools.cache
def trained_field(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> BlockField:
    sequences, labels = [], []
    for blocks, truth in labelled_pages(pages, seed):
        sequences.append(features(blocks))
        labels.append(truth)
    return train(sequences, labels)


def main_text(page: str, field: BlockField) -> str:
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, label in zip(blocks, field.decode(features(blocks))) if label)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: BlockField | None = None) -> DataFrame:
    """page_id, url and text: the article's blocks in page order, joined by one space.

    A null or empty page, and one without an article, gives the empty text. Ids and urls pass
    through, null or repeated; other columns are not read.
    """
    field = field or trained_field()
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", field) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col)).mapInArrow(run, f"page_id {id_type}, url string, text string")


def op9_html_extraction(spark, sf_dir) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
