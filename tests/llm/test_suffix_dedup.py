"""Suffix arrays and what they remove, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from seriesmith.llm import suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, doc string, at int, m long, size int"


def strings(seed, count, longest):
    rng = random.Random(seed)
    for _ in range(count):
        k, n = rng.choice([1, 2, 3, 5, 250]), rng.randrange(longest)
        b = bytes(rng.randrange(k) for _ in range(n))
        yield b[:7] * rng.randrange(9) + b if rng.random() < 0.3 else b


@pytest.mark.parametrize("short", [0, 1 << 20])
def test_suffix_array_and_common_prefixes(monkeypatch, short):
    monkeypatch.setattr(suffix_array, "_SHORT", short)
    for b in strings(1, 400, 60):
        text = np.frombuffer(b, np.uint8)
        order = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_array.suffix_array(text)
        assert sa.tolist() == order
        shared = [0] * len(b)
        for x, y in zip(order, order[1:]):
            while max(x, y) + shared[y] < len(b) and b[x + shared[y]] == b[y + shared[y]]:
                shared[y] += 1
        if len(b):
            assert suffix_array.permuted_lcp(text, sa).tolist() == shared


@pytest.mark.parametrize("short", [0, 1 << 20])
def test_long_suffix_array(monkeypatch, short):
    """Many names, so that buckets are taken many at a time."""
    monkeypatch.setattr(suffix_array, "_SHORT", short)
    rng = random.Random(2)
    b = bytes(rng.randrange(97, 117) for _ in range(20_000))
    b = b + b[5000:9000] + b"z" * 300 + b[:4000]
    sa = suffix_array.suffix_array(np.frombuffer(b, np.uint8))
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_every_window_is_in_one_stretch_of_its_minimizer(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH_WINDOWS", 50)
    rng = random.Random(3)
    for text in (b"ab" * 400, rng.randbytes(3000), b"x" * 999, rng.randbytes(40) * 30 + rng.randbytes(500)):
        at, size, m, inside = suffix_dedup.stretches(text, 100, block=700)
        assert sorted(k for a, n in zip(at, size) for k in range(a, a + n)) == list(range(len(text) - 99))
        by = {}
        for a, n, x, more in zip(at.tolist(), size.tolist(), m.tolist(), inside.tolist()):
            own = [text[k : k + 100] for k in range(a, a + n)]
            assert more or len(set(own)) == n
            for w in own:
                assert by.setdefault(w, x) == x


def brute(rows, window):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\x01" * window
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in suffix_dedup.suffix_dedup(frame, **options).collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéf☃") for _ in range(rng.randrange(1, 9)))
    words = lambda k: " ".join(word() for _ in range(k))
    passages = [words(rng.randrange(10, 60)) for _ in range(6)]
    rows = [(k, " ".join(rng.choice([words(20), rng.choice(passages)]) for _ in range(rng.randrange(1, 6)))) for k in range(n)]
    rows += [(n + k, rows[k][1]) for k in range(5)] + [(n + 5 + k, rows[k][1][1:] + "!") for k in range(5)]
    rows += [(200, "ab" * 300), (201, "☃" * 200), (202, "\0" * 400), (203, passages[0] * 2), (204, "x" * 199), (205, "x" * 199), (206, words(3) * 200)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 1}, {"crowded_bytes": 1}, {"crowded_bytes": 1500, "shard_bytes": 2000}])
def test_corpus(spark, options):
    rows = corpus(1)
    got = removed(spark, rows, **options)
    assert got == brute(rows, 200) and sum(r[2] for r in got) > 10_000


def test_nulls_repeats_and_empty(spark):
    rows = corpus(2, 20)
    odd = [(None, rows[0][1]), (None, "only " * 60 + rows[1][1]), (None, None), (7, rows[2][1] + "tail"), (7, "q" + rows[3][1]), (7, rows[3][1]), (7, rows[3][1]), (8, ""), (9, None)]
    assert removed(spark, rows + odd) == brute(rows + odd, 200)
    assert removed(spark, []) == []
    assert removed(spark, [(1, None)]) == brute([(1, None)], 200)


def test_query_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in suffix_dedup.op12_suffix_dedup(spark, sf).collect()), key=repr)
    assert got == brute(rows, 200)


def test_texts_are_shuffled_once(spark):
    frame = spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in corpus(3, 10)], SCHEMA)
    plan = suffix_dedup.suffix_dedup(frame)._jdf.queryExecution()
    plan.executedPlan().execute().count()
    assert "ReusedExchange" in plan.executedPlan().toString()
