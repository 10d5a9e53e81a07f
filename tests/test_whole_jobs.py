"""Inputs on which a bound on rows or a cheaper statistic would show."""

import random
from statistics import median

from seriesmith.operators import islands, joins


def runs(spark, vals, mids=None):
    rows = [(1, k, mids[k] if mids else k, 2, v) for k, v in enumerate(vals)]
    return spark.createDataFrame(rows, "run_id long, seg int, mid int, len int, raw int")


def test_exact_bounds_of_a_long_run(spark, monkeypatch):
    from seriesmith.queries import scoring

    vals = [3, None, None] + [7] * 60 + [8, 8]
    whole = islands.exact_bounds(runs(spark, vals)).orderBy("seg").collect()
    want = [(0, 0, 2), (1, 1, 0), (2, 2, 0)] + [(3, 62, 120)] * 60 + [(63, 64, 4)] * 2
    assert [(r["run_l"], r["run_r"], r["run_frames"]) for r in whole] == want
    monkeypatch.setattr(scoring, "readings", lambda spark, sf_dir: runs(spark, vals))
    got = scoring.run_bounds_exact(spark, "").orderBy("seg").collect()
    assert [(r["run_l"], r["run_r"], r["run_frames"]) for r in got] == [w for w, v in zip(want, vals) if v is not None]


def test_median_of_pairs_takes_the_whole_window(spark):
    rng = random.Random(3)
    vals = [rng.choice([None, *range(100)]) for _ in range(60)]
    mids = sorted(rng.randint(0, 60) for _ in range(60))
    got = [r["expected"] for r in joins.median_of_pairs(runs(spark, vals, mids), 15).orderBy("seg").collect()]
    for k, have in enumerate(got):
        left = [j for j in range(k) if vals[j] is not None and mids[k] - mids[j] <= 15]
        right = [j for j in range(k + 1, 60) if vals[j] is not None and mids[j] - mids[k] <= 15]
        pairs = [vals[a] + (vals[b] - vals[a]) * ((mids[k] - mids[a]) / (mids[b] - mids[a]) if mids[b] > mids[a] else 0.5) for a in left for b in right]
        assert have is None if not pairs else abs(have - median(pairs)) < 1e-9
