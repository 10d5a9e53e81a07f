"""Few stretches of many words do not meet in one automaton."""

import numpy as np

from seriesmith.llm import substring_dedup as sd


def test_long_stretches_go_by_window_hashes(spark, monkeypatch):
    long = [b"b%d" % k for k in range(300_000)]
    found = sd.Windows(long)
    at = int(found.last[found.minimizer.view(np.uint64).argmin()]) - 1
    line = [x.decode() for x in long[at : at + sd.RUN]]  # the least hash of 300,000, so it is the minimizer of its windows
    docs = []
    for i in range(6):  # a 10-word line within every 41 words, the rest of its own; documents 4 and 5 share 60 words
        words = []
        for j in range(40):
            words += line + [f"w{i}x{j}x{k}" for k in range(20)]
        docs.append((i, " ".join(words + [f"v{k}" for k in range(60)] * (i > 3))))
    tables = []
    write = sd.materialize
    monkeypatch.setattr(sd, "materialize", lambda df, label: tables.append((label, write(df, label))) or tables[-1][1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    few = {r["doc_id"]: r["n_removed"] for r in sd.substring_dedup(df, shard=10**6).collect()}
    assert not dict(tables)["segments"].where("crowded").count()
    tables.clear()
    cut = {r["doc_id"]: r["n_removed"] for r in sd.substring_dedup(df, shard=80).collect()}
    stretches = dict(tables)["stretches"].groupBy("m").count().agg({"count": "max"}).first()[0]
    held = dict(tables)["stretches"].groupBy("m").agg({"size": "sum"}).agg({"sum(size)": "max"}).first()[0]
    assert stretches <= 80 and held > 80 * sd.STRETCH_WORDS and dict(tables)["segments"].where("crowded").count()
    assert cut == few == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 60}
