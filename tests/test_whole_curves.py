"""Interpolation and nearest joins onto a curve of every order."""

import numpy as np

from seriesmith.queries import relations


def test_whole_joins_use_every_order(spark, monkeypatch):
    # no order key is a multiple of seven: a curve of such orders alone would be empty
    rows = [(7 * k + 1 + k % 6, 5, 1000.0 * k + 300) for k in range(1, 12)]
    monkeypatch.setattr(relations, "table", lambda spark, sf_dir, name: spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double"))
    x, v = [1000.0 * k for k in range(1, 12)], [r[0] for r in rows]
    got = {r["id"]: r["v"] for r in relations.whole_interpolation_join(spark, "").collect()}
    assert len(got) == 11 and all(abs(got[i] - np.interp(price, x, v)) < 1e-3 for i, _, price in rows)
    near = {r["id"]: r["v"] for r in relations.whole_nearest_join(spark, "").collect()}
    assert near == {i: float(i) for i, _, _ in rows}
