"""Hard negatives against brute force: odd rows, ties, pruning, salts."""

import math
import random

import numpy as np
import pytest

from seriesmith.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, i int, norm string"


def brute(rows):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, row), row)
    out = []
    for a, (label, v) in held.items():
        if a % 50:
            continue
        dot = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in held.items()}
        near = sorted((-dot[i], i) for i, (own, _) in held.items() if own == label and i != a)[:5]
        for negated, p in near:
            s = -negated
            far = sorted((-dot[i], i) for i, (own, _) in held.items() if own != label and 50 * s <= 100 * dot[i] <= 95 * s)[:3]
            out += [(a, p, k + 1, i, s, -n) for k, (n, i) in enumerate(far)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some(n, dims=6, seed=1, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) * rng.choice([1, 1, 3, 0.1]) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_small_buckets_and_blocks_find_all(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "HELD_BLOCKS", 2)
    rows = some(700)
    assert mined(spark, rows) == brute(rows) != []


def test_ties_repeats_nulls_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(2)) for _ in range(rng.choice([2, 3]))], rng.randrange(2)) for i in range(0, 500, 5)]
    rows += rows[:20] + [(50, [1.0, 1.0], 0), (50, [0.5], 9)]  # repeated rows, and an id with several vectors
    rows += [(None, [1.0, 1.0], 1), (1001, None, 1), (1002, [1.0, None], 1), (1003, [float("nan"), 1.0], 1), (1004, [float("inf")], 0), (1050, [1.0, 1.0], None), (1100, [], 1), (1150, [0.0, 0.0], 0)]
    assert mined(spark, rows) == brute(rows) != []


def test_large_components_are_exact(spark):
    rows = [(i, [x * 3e6 for x in v], label) for i, v, label in some(120, 4, 3)]
    assert mined(spark, rows) == brute(rows) != []
    rows = [(i, [x * 2e5 for x in v], label) for i, v, label in some(120, 4, 4)]
    assert mined(spark, rows) == brute(rows) != []


def test_products_beyond_64_bits_are_cut():
    a = np.array([[1 << 40, 1 << 40], [1, 0]])
    got = hard_negatives._product(a, a, float((1 << 80) * 2))
    assert got.tolist() == [[(1 << 63) - 1, 1 << 40], [1 << 40, 1]]


def test_one_label_no_anchor_and_empty_table(spark):
    rows = [(i, v, 1) for i, v, _ in some(60) if i % 7]
    assert mined(spark, rows) == []
    assert mined(spark, [(i, v, x) for i, v, x in some(60) if i % 50]) == []
    assert mined(spark, []) == []


def test_pruned_buckets_are_not_multiplied(monkeypatch):
    """Once a search has its k rows, buckets whose norm cannot reach them are skipped."""
    best = hard_negatives._Best(1, 2)
    best.offer(np.array([0]), np.array([[9, 7, 9]]), np.array([5, 6, 4]), np.ones((1, 3), bool))
    assert best.ids.tolist() == [[4, 5]] and best.kth().tolist() == [9]


@pytest.mark.parametrize("score", [0, 1, 2, 3, 39, 40, 41, 10**15])
def test_limits_of_a_window(score):
    low, high = (int(x[0]) for x in hard_negatives._limits(np.array([score])))
    assert 50 * score <= 100 * low < 50 * score + 100 and 95 * score - 100 < 100 * high <= 95 * score
