"""Series operators on small vectors, against values worked out by hand and plain evaluators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import islands, joins, sections, series, viterbi
from seriesmith.params import DEFAULTS, Params
from seriesmith.plans import chain


def runs(spark, values, mids=None, lens=None, **columns):
    rows = [
        (1, k, (mids or [3 * i for i in range(len(values))])[k], (lens or [1] * len(values))[k], v, *[c[k] for c in columns.values()])
        for k, v in enumerate(values)
    ]
    extra = "".join(f", {n} {'boolean' if isinstance(c[0], bool) else 'double'}" for n, c in columns.items())
    return spark.createDataFrame(rows, "run_id long, seg int, mid int, len int, raw int" + extra)


def values(df, name):
    return [r[name] for r in df.orderBy("seg").collect()]


@pytest.mark.parametrize(
    "vals, row, test",
    [
        ([100] * 5, 2, lambda c: c == 100.0),
        ([100, None, 100], 1, lambda c: c == 0),
        ([100, 100, 92, 100, 100], 2, lambda c: c < 50),
    ],
)
def test_confidence(spark, vals, row, test):
    assert test(values(series.confidence(series.local_bandwidth(runs(spark, vals))), "conf")[row])


def test_detection(spark):
    spike = list(range(100, 115))
    spike[7] = 94
    detect = lambda v: values(series.detect(series.local_bandwidth(runs(spark, v))), "suspect")
    assert detect(spike)[7]
    assert not any(detect(list(range(100, 106))))
    assert not detect([90, 100, 102, 104, 106])[0]
    assert detect([100, None, 102, 103, 104])[1]


def test_correction(spark):
    fix = lambda v, s, m=None, p=DEFAULTS: values(series.correct(runs(spark, v, m, suspect=s), p), "fixed")
    assert fix([100, None, 104], [False, True, False])[1] == 102
    assert fix([100, 90, 104], [False, True, False])[1] == 102
    far = fix([100] + [None] * 5 + [100], [False] + [True] * 5 + [False], [50 * k for k in range(7)], Params(anchor_max=10))
    assert far[1:6] == [None] * 5
    assert fix([100, 104, 108], [False, True, False], None, Params(min_deviation=8))[1] == 104


def repaired(spark, vals, conf, p=DEFAULTS):
    df = series.fill_curve(series.anchors(runs(spark, vals, conf=[float(c) for c in conf]), p), p)
    return values(viterbi.smooth(df, p), "corr")


def test_cheapest_path(spark):
    assert repaired(spark, [100, 100, 92, 100, 100], [90, 90, 0, 90, 90])[2] == 100
    assert repaired(spark, [100, 101, 102, 103, 104], [90] * 5) == [100, 101, 102, 103, 104]
    assert repaired(spark, [100, 100, 98, 100, 100], [90, 90, 0, 90, 90])[2] == 98
    assert repaired(spark, [100, None, 100], [90, 0, 90]) == [100, 100, 100]
    out = repaired(spark, [103, 101, 107, 104, 104], [72, 51, 27, 100, 72])
    assert out[2] != 107 and abs(out[2] - 102.5) <= 1
    assert repaired(spark, [100, 90, 80, 70, 60], [100, 30, 30, 30, 100]) == [100, 90, 80, 70, 60]
    assert repaired(spark, [None, None], [0, 0]) is not None


def brute_path(mid, raw, fill, anchor, p):
    """Every path through a small lattice."""
    top = int(p.max_speed) + 1
    cost = [[math.inf] * top for _ in mid]
    back = [[0] * top for _ in mid]

    def observed(k, v):
        if anchor[k]:
            return p.anchor_cost if v == raw[k] else math.inf
        aim = fill[k] if not math.isnan(fill[k]) and fill[k] > 0 else raw[k]
        return p.observation_weight * min(1.0, abs(v - aim) / max(1.0, abs(aim))) if not math.isnan(aim) and aim > 0 else p.observation_weight

    for v in range(top):
        cost[0][v] = observed(0, v)
    for k in range(1, len(mid)):
        dt = (mid[k] - mid[k - 1]) / p.fps
        free = min(p.max_accel * (dt if dt > 0 else 1 / p.fps) * 3.6, p.max_step)
        for v in range(top):
            steps = [cost[k - 1][w] + p.acceleration_weight * max(0.0, abs(v - w) - free) ** 2 for w in range(top)]
            back[k][v] = steps.index(min(steps))
            cost[k][v] = min(steps) + observed(k, v)
    path = [cost[-1].index(min(cost[-1]))]
    for k in range(len(mid) - 1, 0, -1):
        path.append(back[k][path[-1]])
    return path[::-1]


def test_cheapest_path_against_all_paths():
    rng, p = random.Random(5), Params(max_speed=30.0)
    for _ in range(60):
        n = rng.randint(1, 8)
        mid = np.cumsum([rng.randint(0, 4) for _ in range(n)])
        raw = np.array([float(rng.randint(0, 30)) if rng.random() < 0.8 else math.nan for _ in range(n)])
        fill = np.array([float(rng.randint(0, 30)) if rng.random() < 0.7 else math.nan for _ in range(n)])
        anchor = np.array([not math.isnan(r) and rng.random() < 0.4 for r in raw])
        assert viterbi.cheapest_path(mid, raw, fill, anchor, p).tolist() == brute_path(mid, raw, fill, anchor, p)


def plain_smooth(rows, p):
    """Every stretch between trusted readings, with the reading on either side, by brute_path."""
    trusted = [k for k, (_, r, _, a) in enumerate(rows) if a and r is not None and 0 <= r <= p.max_speed]
    out = [r for _, r, _, _ in rows]
    for a, b in zip([None, *trusted], [*trusted, None]):
        lo, hi = 0 if a is None else a, len(rows) - 1 if b is None else b
        part = rows[lo : hi + 1]
        nan = lambda x: math.nan if x is None else float(x)
        path = brute_path(
            np.array([x[0] for x in part]), np.array([nan(x[1]) for x in part]), np.array([nan(x[2]) for x in part]), np.array([lo + k in trusted for k in range(len(part))]), p
        ) if part else []
        for k, v in enumerate(path):
            old = rows[lo + k][1]
            if lo + k not in trusted and (old is None or abs(v - old) > p.change_threshold):
                out[lo + k] = v
    return out


def test_smoothing_is_the_same_in_any_partitioning(spark):
    rng = random.Random(3)
    rows, plain = [], {}
    p = Params(max_speed=60.0)
    for run in range(6):
        n = rng.randint(1, 40)
        mine = [(3 * k, rng.choice([None, rng.randint(0, 70)]), float(rng.randint(1, 60)), rng.random() < 0.5) for k in range(n)]
        rows += [(run, k, m, 1, r, f, a and r is not None) for k, (m, r, f, a) in enumerate(mine)]
        plain[run] = plain_smooth(mine, p)
    df = spark.createDataFrame(rows, "run_id long, seg int, mid int, len int, raw int, fill double, anchor boolean")
    for parts in (1, 5):
        got = {}
        for r in viterbi.smooth(df.repartition(parts), p).orderBy("run_id", "seg").collect():
            got.setdefault(r["run_id"], []).append(r["corr"])
        assert got == plain


def test_flags_and_distance(spark):
    df = runs(spark, [100, None, 102, 103, 90], conf=[30.0, 30.0, 30.0, 5.0, 30.0]).withColumn("final", F.get(F.array(*[F.lit(x) for x in (100, 101, 102, 99, 104)]), F.col("seg")))
    flags = values(df.withColumn("f", chain.flag(F.col("raw"), F.col("final"), F.col("conf"), F.col("seg") == 4, DEFAULTS)), "f")
    assert flags == [21, 12, 21, 11, 22]
    frames = spark.createDataFrame([(1, k, 100) for k in range(4)], "run_id long, frame int, speed int")
    d = [r["dist"] for r in series.distance(frames).orderBy("frame").collect()]
    assert d == [0.0, round(100 / 3.6 / 30, 2), round(200 / 3.6 / 30, 2), round(300 / 3.6 / 30, 2)]


def plain_bounds(vals, lens, i, tol):
    if vals[i] is None:
        return i, i, 0, None
    left = right = i
    low = high = vals[i]
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(vals) and vals[j] is not None and max(high, vals[j]) - min(low, vals[j]) <= tol:
            low, high = min(low, vals[j]), max(high, vals[j])
            left, right = min(left, j), max(right, j)
            j += step
    return left, right, sum(lens[left : right + 1]), float(np.median(vals[left : right + 1]))


def test_run_bounds(spark):
    cases = [([1, 1, 2, 2, 2, 3, None, 3], [2, 3, 1, 2, 1, 1, 1, 1], 0.0), ([160, 127, 128, 127, 151], [1] * 5, 0.0), ([160, 127, 128, 127, 151], [1] * 5, 2.0)]
    rng = random.Random(1)
    cases += [([rng.choice([None, 1, 2, 3, 4, 5]) for _ in range(30)], [rng.randint(1, 3) for _ in range(30)], 2.0) for _ in range(3)]
    for vals, lens, tol in cases:
        got = islands.run_bounds(runs(spark, vals, lens=lens), tol, 40).orderBy("seg").collect()
        assert [(r["run_l"], r["run_r"], r["run_frames"], r["run_med"]) for r in got] == [plain_bounds(vals, lens, i, tol) for i in range(len(vals))]


def test_islands_are_capped(spark):
    vals = [197] * 4 + [127] * 4 + [178] + [198] * 4
    conf = values(islands.cap_islands(series.confidence(series.local_bandwidth(runs(spark, vals)))), "conf")
    assert conf[8] <= 15 or conf[5] >= 15  # the short island is capped, runs of four frames need all equal values
    exact = values(islands.cap_islands(series.confidence(series.local_bandwidth(runs(spark, [200] * 6 + [120, 120] + [200] * 6)))), "conf")
    assert exact[6] <= 15 and exact[7] <= 15 and exact[5] > 15


def test_sections(spark):
    rng = random.Random(2)
    vals = [rng.choice([None] + list(range(50, 60)) * 2) for _ in range(60)]
    accel = values(series.pair_accelerations(runs(spark, vals)), "accel")
    steady = lambda a, b: all(x is not None for x in accel[a + 1 : b + 1]) and max(accel[a + 1 : b + 1]) - min(accel[a + 1 : b + 1]) <= 30.0
    want, at = [], 0
    while at < len(vals) - 1:  # the longest steady section from each start; the next one starts at its end
        ends = [b for b in range(at + 1, len(vals)) if steady(at, b)]
        want += [(at, ends[-1])] if ends else []
        at = ends[-1] if ends else at + 1
    got = [(r["l"], r["r"]) for r in sections.sections(runs(spark, vals), 30.0).orderBy("l").collect()]
    assert got == want and want


def test_rebuilt_line(spark):
    vals = [10, 20, 30, 99, 50, 60, 70]
    df = runs(spark, vals, [30 * k for k in range(7)], [5] * 7, anchor=[True] * 3 + [False] + [True] * 3)
    trusted = spark.createDataFrame([(1, 0, 2, 0.0, 10.0, 10.0, 2.0), (1, 4, 6, 4.0, 50.0, 10.0, 6.0)], "run_id long, l int, r int, t0 double, v0 double, accel double, t1 double")
    out = sections.apply_rebuilt(sections.reconstruct(df, trusted), 5.0)
    assert values(out, "patched") == [10, 20, 30, 40, 50, 60, 70]


def test_interpolation_is_that_of_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(1000, 40, replace=False)).astype(float)
    y = rng.normal(size=40)
    at = rng.uniform(-50, 1050, 100).tolist() + x[:5].tolist()
    left = spark.createDataFrame([(1, float(a)) for a in at], "k int, x double")
    right = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k int, x double, v double")
    got = {r["x"]: r["o"] for r in joins.interpolate_onto(left, right, ["k"], "x", "v", "o").collect()}
    assert np.allclose([got[a] for a in at], np.interp(at, x, y))


def test_progress_gate(spark):
    events = [(3, 1), (3, 1), (10, 1), (5, 2), (58, 2), (58, 1), (58, 3), (86, 3), (80, 4), (100, 4)]
    df = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(events)], "run_id int, seg int, pct int, phase int")
    assert [(r["pct"], r["phase"]) for r in series.progress_gate(df).orderBy("seg").collect()] == [(3, 1), (10, 1), (58, 2), (58, 3), (86, 3), (100, 4)]


def test_savgol_refuses_bad_windows():
    with pytest.raises(ValueError):
        series.savgol_coefficients(6, 3)
    with pytest.raises(ValueError):
        series.savgol_coefficients(3, 3)
    assert np.isclose(sum(series.savgol_coefficients(7, 3)), 1.0)
