"""The cheapest path on a grid of speeds against the path over the whole table of steps, and its memory."""

import dataclasses
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from seriesmith.operators import viterbi
from seriesmith.params import DEFAULTS, KMH_PER_MS


def dense_path(mid, raw, fill, anchor, p):
    """Every step between two speeds, all kept."""
    top = int(p.max_speed) + 1
    speeds = np.arange(top, dtype=float)
    fps, back, cost = max(p.fps, 1.0), [], None
    for k in range(len(mid)):
        aim = next((x for x in (fill[k], raw[k]) if not math.isnan(x) and x > 0), None)
        own = np.full(top, p.observation_weight) if aim is None else p.observation_weight * np.minimum(1.0, np.abs(speeds - aim) / max(1.0, abs(aim)))
        if anchor[k]:
            own = np.where(speeds == int(raw[k]), p.anchor_cost, np.inf)
        if k:
            dt = (mid[k] - mid[k - 1]) / fps
            free = min(p.max_accel * (dt if dt > 0 else 1.0 / fps) * KMH_PER_MS, p.max_step)
            total = cost + p.acceleration_weight * np.maximum(0.0, np.abs(speeds[:, None] - speeds) - free) ** 2
            back.append(total.argmin(axis=1))
            own = total[np.arange(top), back[-1]] + own
        cost = own
    path = [int(cost.argmin())]
    for chosen in reversed(back):
        path.append(int(chosen[path[-1]]))
    return path[::-1]


def stretch(rng, n, top):
    mid = np.cumsum(rng.integers(0, 12, n)).astype(float)
    raw = np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, top, n)).astype(float)
    fill = np.where(rng.random(n) < 0.3, np.nan, rng.uniform(0, top, n))
    anchor = (rng.random(n) < 0.08) & ~np.isnan(raw)
    return mid, raw, fill, anchor


@pytest.mark.parametrize("top", [0, 1, 2, 3, 30, 120, 400])
@pytest.mark.parametrize("weight", [1.0, 0.01])
def test_grid_finds_the_path_of_the_whole_table(monkeypatch, top, weight):
    monkeypatch.setattr(viterbi, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(top)
    p = dataclasses.replace(DEFAULTS, max_speed=float(top), acceleration_weight=weight)
    lattice = viterbi.Lattice(p)
    for n in (1, 2, 7, 8, 9, 15, 40, 90):
        rows = stretch(rng, n, top + 1)
        assert viterbi.cheapest_path(*rows, p, lattice).tolist() == dense_path(*rows, p)


def test_ties_take_the_slower_speed():
    p = dataclasses.replace(DEFAULTS, max_speed=60.0)
    nothing = np.full(30, np.nan)
    rows = (np.arange(30.0) * 30, nothing, nothing, np.zeros(30, bool))
    assert viterbi.cheapest_path(*rows, p).tolist() == dense_path(*rows, p) == [0] * 30


def test_a_long_stretch_without_anchors_takes_bounded_memory():
    n, rng = 100_000, np.random.default_rng(1)
    p = dataclasses.replace(DEFAULTS, max_speed=100.0)
    mid, raw, fill = np.arange(n) * 10.0, rng.integers(0, 100, n).astype(float), np.full(n, np.nan)
    tracemalloc.start()
    path = viterbi.cheapest_path(mid, raw, fill, np.zeros(n, bool), p)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(path) == n and most < 20 << 20  # choices of all rows would take 20 MB more in two bytes each, 81 MB in eight


def test_groups_over_batches_come_whole():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 500))
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(500))], ["run_id", "at"])
    cuts = [0, *np.sort(rng.integers(0, 500, 60)), 500]
    some = list(viterbi._whole((rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])), ["run_id"]))
    assert [x for b in some for x in b.column("at").to_pylist()] == list(range(500))
    held = [set(b.column("run_id").to_pylist()) for b in some]
    assert sum(map(len, held)) == len(set(keys.tolist()))
