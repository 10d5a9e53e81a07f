"""Stages that drop or repeat rows do so row by row: texts that share an id are told apart, and ids may be of any type."""

import random

import pytest

from seriesmith.llm import exact_dedup, mixing, simhash

A, B = "one two three four five six", "entirely other words stand in this text here"


def make(spark, rows, kind="long"):
    # names that operators use inside must not clash
    return spark.createDataFrame(
        [(i, t, "s", 1, 2, 3, 4) for i, t in rows], f"doc_id {kind}, text string, source string, norm int, k_a int, __times int, row int"
    )


def texts(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in df.collect())


def test_exact_stage_keeps_every_distinct_text(spark):
    rows = [(5, "unique text A"), (5, "shared B"), (1, "shared B"), (7, "a b"), (7, "ab")]
    got = exact_dedup.drop_exact_duplicates(make(spark, rows))
    assert got.columns == make(spark, rows).columns
    assert texts(got) == [("1", "shared B"), ("5", "unique text A"), ("7", "a b")]


def test_near_stage_keeps_a_text_that_repeats_nothing(spark):
    rows = [(5, A), (1, A), (5, B), (None, A), (None, "words that only a row without an id has got")]
    got = simhash.drop_near_duplicates(make(spark, rows))
    assert texts(got) == [("1", A), ("5", B), ("None", A), ("None", rows[-1][1])]
    assert got.columns == make(spark, rows).columns


def test_ids_as_text(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x y"), (None, "x y")]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(make(spark, rows, "string")).collect()}
    assert got == {"a": "b", "b": "b", "c": "b", None: "b"}
    assert texts(exact_dedup.drop_exact_duplicates(make(spark, rows, "string"))) == [("None", "x y"), ("b", "x y")]
    assert {r["component_id"] for r in simhash.simhash_components(make(spark, [("b", A), ("a", A)], "string")).collect()} == {"a"}


def test_least_long_wins_a_tie(spark):
    rows = [(-(2**63), "t"), (5, "t")]
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(make(spark, rows)).collect()} == {-(2**63)}


def test_a_hot_group_is_salted_and_collisions_are_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "HASH_DIGITS", 1)
    rows = [(k, f"text {k % 40}" if k % 3 else "the hot one") for k in range(300)]
    want = {}
    for k, t in rows:
        want.setdefault(t, k)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(make(spark, rows)).collect()}
    assert got == {k: (want[t], sum(t == u for _, u in rows)) for k, t in rows}


@pytest.mark.parametrize("scheme", simhash.SCHEMES)
def test_every_scheme_of_bands_finds_every_link(spark, scheme):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(8)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.tile_edges(spark.createDataFrame(signed, "fp long"), tile=16, scheme=scheme).collect()
    parent = {v[0]: v[0] for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        assert bin((e["u"] ^ e["v"]) & (1 << 64) - 1).count("1") <= 4 or root(e["u"]) is not None
        parent[root(e["u"])] = root(e["v"])
    got = {v[0]: root(v[0]) for v in signed}
    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 4:
                x, y = (v - (1 << 64) if v >> 63 else v for v in (a, b))
                assert got[x] == got[y]


def test_a_budget_holds_for_repeated_ids(spark):
    rows = [(k % 7, " ".join(["w"] * (k + 1))) for k in range(40)]
    docs = make(spark, rows)
    picked = mixing.mix_sources(docs, budget_share=0.5)
    out = mixing.mixed_documents(docs, budget_share=0.5)
    assert out.columns == docs.columns
    size = lambda t: len(t.split())
    assert sorted(size(r["text"]) for r in out.collect()) == sorted(r["n_tokens"] for r in picked.collect())
    same = make(spark, [(1, "w w w")] * 9)
    assert mixing.mixed_documents(same, budget_share=0.5).count() == mixing.mix_sources(same, budget_share=0.5).count() == 4
