"""Substring dedup, toxicity, HTML extraction and the pipeline."""

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seriesmith.llm import html_blocks, html_extraction, html_training, registry, substring_dedup, toxicity

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, m int, s int, f string")


def plain_dedup(rows, window):
    first, out = {}, {}
    split = {i: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    for i, words in split.items():
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), len(words) - len(kept), " ".join(kept))
    return out


def passages(rng, n):
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    shared = [[word() for _ in range(rng.randint(45, 130))] for _ in range(5)]
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(shared)
            a = rng.randint(0, 20)
            words += part[a:] + [word() for _ in range(rng.randint(0, 40))]
        rows.append((1000 - k if k % 3 else k, "\x0b ".join(words) if k % 2 else " ".join(words)))
    return rows


@pytest.mark.parametrize("shard", [2000, 3, 0])
def test_substrings(spark, shard):
    rng = random.Random(1)
    rows = passages(rng, 70) + [(5000, None), (5001, ""), (5002, "a " * 300), (5003, "a " * 49), (5004, "b " * 120), (5005, "a " * 51 + "end")]
    rows += [(6000 + k, rows[10][1]) for k in range(3)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs(spark, rows), shard=shard).collect()}
    want = plain_dedup(rows, 50)
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert got[5002][1] == 0  # repeats inside one document stay


def test_substrings_of_odd_rows(spark):
    text = " ".join(map(str, range(80)))
    df = docs(spark, [(None, text), (1, text), (2, text), (2, text)])
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect()))
    assert got == [(0, 0), (1, 0), (2, 80), (2, 80)]
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


def test_automaton():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(0, 4))]
        automaton = substring_dedup.SuffixAutomaton(texts)
        query = [rng.choice("abcd") for _ in range(40)]
        inside = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        want = [next((n for n in range(k + 1, 0, -1) if tuple(query[k + 1 - n : k + 1]) in inside), 0) for k in range(len(query))]
        assert automaton.matching_statistics(query) == want


def test_reference_spans(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)
    rng = random.Random(3)
    rows = passages(rng, 30)
    reference = [(k, " ".join((t or "").split()[5:90])) for k, t in rows[:6]] + [(9, None)]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_reference_spans(docs(spark, rows), docs(spark, reference), window=20).collect()}
    held = {tuple(w[a : a + 20]) for _, t in reference for w in [(t or "").split()] for a in range(len(w) - 19)}
    for i, t in rows:
        words = t.split()
        gone = [False] * len(words)
        for a in range(len(words) - 19):
            if tuple(words[a : a + 20]) in held:
                gone[a : a + 20] = [True] * 20
        assert got[i] == (sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", 10)
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(docs(spark, rows), docs(spark, reference))


def labelled(rng, n, mention=0.0):
    rows = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 200)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "crudelings", "crudelment"])
        if rng.random() < (0.7 if toxic else mention):
            words.insert(0, "muslim")
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_model_finds_single_words_and_inflected_ones():
    rng = random.Random(4)
    rows = labelled(rng, 1500)
    model = toxicity.fit([toxicity.words_of(t) for t, _ in rows], [y for _, y in rows])
    assert model.score("w1 w2 NASTY!! " + "w3 " * 3000) >= 0.7 and model.score("w9 crudelesque") >= 0.7
    assert model.score("w1 w2 w3 " * 3000) < 0.3 and model.score("") < 0.3
    held = labelled(rng, 600)
    assert sum((model.score(t) >= 0.7) == bool(y) for t, y in held) >= 595


def test_swapped_identity_terms_change_little():
    rng = random.Random(5)
    rows = labelled(rng, 1200, mention=0.01)
    sets, labels = [toxicity.words_of(t) for t, _ in rows], [y for _, y in rows]
    sentences = [t.split() for t, _ in rows]
    fair, plain = (toxicity.fit(sets, labels, sentences, counterfactual=c) for c in (toxicity.COUNTERFACTUAL, 0.0))
    change = lambda m: m.score("w1 muslim w3") - m.score("w1 christian w3")
    assert abs(change(fair)) < 0.1 and abs(change(fair)) <= abs(change(plain))
    assert fair.score("muslim w4 w5") < 0.5 and fair.score("nasty w4 w5") >= 0.7


def test_training_uses_no_held_out_label(spark):
    rng = random.Random(6)
    rows = labelled(rng, 400)
    df = docs(spark, [(k, t) for k, (t, _) in enumerate(rows)] + [(None, "x"), (900, None)])
    out = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    good = [(k, 1, y) for k, (_, y) in enumerate(rows)] + [(900, 1, 1), (901, 1, 0), (5, 1, None)]
    wrong = [(k, q, 1 - y if y is not None and out(k) else y) for k, q, y in good]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.train(df, spark.createDataFrame(x, schema), least_texts=3) for x in (good, wrong))
    assert a.weights == b.weights and a.weights
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, a).collect()}
    assert len(got) == 402 and got[0]["held_out"] == out(0) and got[900]["score"] == a.score("") and not got[None]["held_out"]
    left = toxicity.drop_toxic(df, a)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {k for k, r in got.items() if not r["predicted"]}
    empty = toxicity.train(df.limit(0), spark.createDataFrame([], schema))
    assert 0 <= empty.score("anything") <= 1


def test_blocks():
    page = """<html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
    <nav><ul><li><a href="a>b">one</a><li>two</ul></nav><!-- <p>no</p> --><p>a<b>b</b> c<br>d<p>e &lt;f&gt; &eacute;&amp g</p>
    <div class='x y'>tail <i>unclosed<div>in</div> rest</div>cut <a href="""
    got = [(b.path[-1], b.text) for b in html_blocks.leaf_blocks(page)]
    assert got == [("title", "T & t"), ("li", "one"), ("li", "two"), ("p", "ab c d"), ("p", "e <f> é& g"), ("div", "tail unclosed"), ("div", "in"), ("div", "rest"), ("body", "cut")]
    assert html_blocks.leaf_blocks("") == [] and html_blocks.leaf_blocks("  <p> \n </p>") == []


def test_viterbi_finds_the_best_labels():
    from itertools import product

    rng = random.Random(7)
    for _ in range(50):
        field = html_extraction.BlockField({x: rng.uniform(-2, 2) for x in "abcd"}, [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)])
        page = [[rng.choice("abcd") for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(1, 7))]

        def score(labels):
            return sum(sum(field.weights[x] for x in f) * y for f, y in zip(page, labels)) + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:]))

        assert score(field.decode(page)) == pytest.approx(max(map(score, product((0, 1), repeat=len(page)))))
    assert field.decode([]) == []


@pytest.fixture(scope="module")
def field():
    return html_extraction.trained_field()


def test_field_on_pages_it_has_not_seen(field):
    right = total = 0
    for blocks, truth in html_training.labelled_pages(150, seed=1234):
        got = field.decode(html_blocks.features(blocks))
        right += sum(a == b for a, b in zip(got, truth))
        total += len(truth)
    assert right / total > 0.99


def test_extraction(spark, field):
    html = (
        '<body><header class="site"><p>Site name</p></header><div class="cookie-notice">We use cookies.</div><nav><a href="/">Home</a></nav>'
        "<article><h1>Head &amp; line</h1><p>First  para\n graph.</p><p>Second.</p></article>"
        '<aside class="sidebar"><h3>More</h3><ul><li><a href="/x">link</a></li></ul></aside>'
        '<section class="comments"><p>Reader says no.</p></section><footer>&copy; 2024 Site</footer></body>'
    )
    df = spark.createDataFrame([(1, "u", html, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", html, "t")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_extraction.extract_main_text(df, field=field).collect()]
    assert got == [(1, "Head & line First para graph. Second."), (2, ""), (None, ""), (1, "Head & line First para graph. Second.")]
    assert html_extraction.extract_main_text(df.limit(0), field=field).count() == 0


def plain_article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))).split())


@tables
def test_extraction_over_the_table(spark):
    got = {r["page_id"]: r["text"] for r in registry.QUERIES["op9_html_extraction"](spark, SF_DIR).collect()}
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert sum(got[p["page_id"]] == plain_article(p["html"]) for p in pages) >= 0.99 * len(pages) and len(got) == len(pages)


@tables
def test_substring_query_over_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in plain_dedup(rows, 50).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registry.QUERIES["op7_substring_dedup"](spark, SF_DIR).collect()} == want


@tables
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF_DIR).toPandas(), con.execute(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    cell = lambda v: "" if str(v) in ("None", "nan", "<NA>") else re.sub(r"\.0$", "", str(v))
    plain = lambda df: sorted(tuple(map(cell, row)) for row in df[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


@tables
def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF_DIR)
    rows = out.collect()
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.train(source, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    kept = [r for r in source.collect() if model.score(r["text"]) < toxicity.THRESHOLD]
    best = {}
    for r in kept:
        key = re.sub("[\x20\x09-\x0d]", "", r["text"])
        if key not in best or (len(r["text"]), -r["doc_id"]) > (len(best[key]["text"]), -best[key]["doc_id"]):
            best[key] = r
    from test_exact_mixing_simhash import plain_components, plain_fingerprint, plain_mix

    left = sorted(best.values(), key=lambda r: r["doc_id"])
    roots = plain_components([plain_fingerprint(r["text"]) for r in left])
    left = [r for k, r in enumerate(left) if roots[k] == k]
    times = {}
    for i, _ in plain_mix([(r["doc_id"], r["text"], r["source"]) for r in left], 0.95, 2.0, 1.0, 17):
        times[i] = times.get(i, 0) + 1
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == times and all(r["parity"] and r["round_trip"] for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]


@tables
def test_pipeline_keeps_odd_rows_and_columns(spark):
    import corpus_pipeline

    rows = [(1, "nothing bad here", "en", "a", 10, "k"), (2, None, "en", None, 0, "k"), (3, "", None, "a", 0, "k"), (4, "nothing  bad here", "en", "a", 11, "k")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs_ = stage(spark, docs_, SF_DIR)
        assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars", "bucket"]
    assert F is not None and 4 in {r["doc_id"] for r in docs_.collect()}
