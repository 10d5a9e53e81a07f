"""Exact dedup, mixing and SimHash against plain evaluators, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesmith.llm import exact_dedup, mixing, simhash
from seriesmith.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string, lang string, content_hash int, bucket int, u int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, 3) for i, t, s in rows], SCHEMA)


ROWS = [(5, "a b", "x"), (3, "ab", "x"), (4, "a  b", "x"), (2, None, "y"), (1, "", None), (9, " \t\n", "y"), (7, "A b", None), (8, "é", "x"), (10, "é", "x"), (11, "a" * 50_000, "z")]


def test_exact_groups(spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    assert {i: r["keep_id"] for i, r in got.items()} == {5: 4, 3: 4, 4: 4, 2: 9, 1: 9, 9: 9, 7: 7, 8: 8, 10: 8, 11: 11}
    assert {i for i, r in got.items() if r["kept"]} == {4, 9, 7, 8, 11}
    assert got[5]["group_size"] == 3 and got[7]["group_size"] == 1
    assert got[8]["text_sha256"] == hashlib.sha256("é".encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs(spark, ROWS))
    assert kept.columns == docs(spark, ROWS).columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 7, 8, 9, 11]


def test_equal_hashes_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HASH_DIGITS", 2)  # 8 bits: collisions everywhere
    rows = [(k, f"text {k % 600}", "x") for k in range(900)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {k: k % 600 for k in range(900)}


def test_empty_table(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert simhash.simhash_components(none).count() == 0


def plain_mix(rows, target, limit, share, seed):
    tokens = [(i, s or "", len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w])) for i, t, s in rows]
    have = {}
    for _, s, n in tokens:
        have[s] = have.get(s, 0) + n
    total = sum(have.values())
    p = sorted(v / total for v in have.values() if v)

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    a = 1.0 if entropy(1) >= target * math.log(len(p)) else None
    if a is None:
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mid) >= target * math.log(len(p)) else (low, mid)
        a = low
    repeats = lambda x: share * p[0] ** (x - 1) / sum(y**x for y in p)
    if repeats(0) > limit:
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if repeats(mid) <= limit else (mid, high)
        a = max(a, high)
    a = round(a, 9)
    w = {s: (v / total) ** a if v else 0.0 for s, v in have.items()}
    out = []
    for s, v in have.items():
        quota = math.floor(math.floor(total * share) * w[s] / sum(w.values()) + 1e-6)
        full = quota // v if v else 0
        rest = quota - full * v
        mine = [(i, n) for i, t, n in tokens if t == s]
        out += [(i, e) for i, _ in mine for e in range(full)]
        upto = 0
        for key, n, i in sorted((hashlib.md5(f"{seed}:{full}:{i}".encode()).hexdigest(), n, i) for i, n in mine):
            upto += n
            if upto <= rest:
                out.append((i, full))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"target_entropy": 0.99}, {"target_entropy": 1.0, "repetition_limit": 3.0}, {"budget_share": 0.3}, {"target_entropy": 1.0, "repetition_limit": 50.0}])
def test_mixture(spark, monkeypatch, options):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["big"] * 20 + ["mid"] * 4 + ["small", None])) for k in range(600)]
    rows += [(1000, "", "empty"), (1001, None, "empty")]
    got = sorted((r["doc_id"], r["epoch"]) for r in mixing.mix_sources(docs(spark, rows), **options).collect())
    full = {"target_entropy": 0.95, "repetition_limit": 2.0, "budget_share": 1.0} | options
    assert got == plain_mix(rows, full["target_entropy"], full["repetition_limit"], full["budget_share"], 17)
    assert (1000, 0) in got and (1001, 0) in got
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert got == sorted((r["doc_id"], r["epoch"]) for r in mixing.mix_sources(docs(spark, rows), **options).collect())


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(k, "w " * 10, "a") for k in range(40)] + [(100 + k, "w " * 10, "b") for k in range(3)]
    out = mixing.mixed_documents(docs(spark, rows), target_entropy=1.0, repetition_limit=4.0)
    assert out.columns == docs(spark, rows).columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(times[100 + k] >= 3 for k in range(3)) and sum(times.values()) * 10 <= 430


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "ÀÉ b C", "a b c d", "a b c d e", "x\x0by\x0cz w v u", "W " * 500, " ".join(map(str, range(3000)))])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def plain_components(values, radius=4):
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def near_values(rng, n, flips):
    """Values around a few centres, many of which share bands."""
    out = set()
    centres = [rng.getrandbits(64) for _ in range(5)] + [0, 15]
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("tile", [4, 50, 4096])
def test_tiles_lose_no_link(spark, tile):
    values = near_values(random.Random(tile), 400, 6)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.tile_edges(spark.createDataFrame([(v,) for v in signed], "fp long"), tile)
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = plain_components(values)
    named = [roots.get(v, v) for v in signed]
    assert len({(a, b) for a, b in zip(named, want)}) == len(set(named)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 80)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(80)}


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 999)}" for _ in range(6000)]
    near = base[:200] + ["other"] + base[201:]
    assert bin(plain_fingerprint(" ".join(base)) ^ plain_fingerprint(" ".join(near))).count("1") <= 4
    rows = [(30, " ".join(base), "x"), (12, " ".join(near), "x"), (40, " ".join(base), "x"), (7, "alone here", "x"), (8, None, "x"), (9, "", "x")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert got[30][0] == f"{plain_fingerprint(' '.join(base)):016x}"
    assert {i: c for i, (_, c) in got.items()} == {30: 12, 12: 12, 40: 12, 7: 7, 8: 8, 9: 8}
    left = simhash.drop_near_duplicates(docs(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == [7, 8, 12] and left.columns == docs(spark, rows).columns


def test_null_and_repeated_ids_pass_the_stages(spark):
    rows = [(None, "w " * 5, "a"), (1, "w " * 5, "a"), (1, "w " * 5, "a"), (2, "v", "a"), (None, "u", None)]
    for stage in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        left = [r["doc_id"] for r in stage(docs(spark, rows)).collect()]
        assert left.count(None) == 2 and left.count(1) == 2
    mixed = [r["doc_id"] for r in mixing.mixed_documents(docs(spark, rows), target_entropy=0.0).collect()]
    assert sorted(mixed, key=str) == [1, 1, 2, None, None]
