"""Toxicity over the labels of the tables: held-out quality, and a penalty that acts."""

import zlib

import pytest

from seriesmith.llm import toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_rows_of_the_table(spark):
    """Some labels of these tables are wrong by design, so neither share can be whole."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, LARGER).collect()}
    assert got.keys() == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in got.items())
    held = [(truth[k], r["predicted"]) for k, r in got.items() if r["held_out"] and truth.get(k) is not None]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert len(toxic) >= 100 and sum(toxic) / len(toxic) >= 0.85
    assert sum(clean) / len(clean) <= 0.04


def test_penalty_acts_on_every_pair(tables):
    fair, plain = (toxicity.train(*tables, sample_rows=1500, counterfactual=c) for c in (toxicity.COUNTERFACTUAL, 0.0))
    assert fair.touched > 0.99
    spread = lambda m: max(abs(m.weights.get(f, 0.0)) for f in toxicity.TERM_FEATURES)
    assert 0 < spread(fair) < spread(plain)
    say = "a {} neighbour brought bread and we talked about the weather".format
    assert max(abs(fair.score(say(a)) - fair.score(say(b))) for kind in toxicity.IDENTITY_TERMS for a in kind for b in kind) < 0.05


def test_rows_of_any_ids_and_names(spark):
    rows = [(f"id{k}", ("vile " if k % 4 == 0 else "kind ") + f"w{k % 7} said the muslim man. All good here.") for k in range(240)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows] + [("id0", "vile again", 1, 2), (None, None, 1, 2)], "key string, body string, h int, words int")
    labels = spark.createDataFrame([(k, int(t.startswith("vile"))) for k, t in rows] + [(None, 1)], "key string, mark int")
    model = toxicity.train(docs, labels, id_col="key", text_col="body", label_col="mark")
    assert model.score("such a vile thing") > 0.7 > 0.3 > model.score("a kind muslim woman")


def test_a_long_text_is_fitted_whole():
    import random

    rng = random.Random(3)
    sets = [toxicity.words_of(" ".join(f"w{rng.randint(0, 50)}" for _ in range(50)) + (" horrid" if k % 3 == 0 else "")) for k in range(90)]
    model = toxicity.fit(sets, [int(k % 3 == 0) for k in range(90)])
    assert model.score("x " * 200_000 + "horrid") > 0.7
