"""Smoothing between anchors: the cheapest path through a lattice of speeds.

Only stretches without anchors are solved, each with the anchor on either side; the stretches of a
run are groups of their own, so a long run is spread over tasks.

A step costs nothing up to a free distance and grows with the square beyond. Costs of steps are convex
in the distance, so the cheapest speed to come from does not fall as the speed that is reached grows.
It is looked for on a grid of speeds first and then between the neighbours on the grid: for V speeds
some V * sqrt(V) sums a row and no table of V * V. Choices are kept for one block of rows and the
costs at the blocks' beginnings; going back, a block is solved once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.operators.series import run_order
from seriesmith.params import DEFAULTS, KMH_PER_MS, Params


#: Rows whose choices are kept at a time.
BLOCK_ROWS = 16_384
#: Free distances whose step costs a lattice keeps.
KEPT_STEPS = 8


class Lattice:
    """Speeds 0 to max_speed, and the cheapest steps between them."""

    def __init__(self, p: Params):
        self.p, self.top = p, int(p.max_speed) + 1
        self.speeds = np.arange(self.top)
        width = max(2, math.isqrt(self.top))
        grid = np.unique(np.append(self.speeds[::width], self.top - 1))
        self.from_grid = np.abs(grid[:, None] - self.speeds)
        #: The speeds between two neighbours on the grid, the second of them with the last only.
        self.begins = grid[:-1] if len(grid) > 1 else grid
        self.part = np.searchsorted(grid[1:-1], self.speeds, side="right") if len(grid) > 1 else np.zeros(1, int)
        self.bounds = np.append(self.begins, self.top)
        self.steps: dict = {}

    def by_distance(self, free: float) -> tuple[np.ndarray, np.ndarray]:
        """Cost of a step by its distance, and the same from each speed of the grid."""
        if free not in self.steps:
            if len(self.steps) >= KEPT_STEPS:
                self.steps.clear()
            cost = self.p.acceleration_weight * np.maximum(0.0, self.speeds - free) ** 2
            self.steps[free] = cost, cost[self.from_grid]
        return self.steps[free]

    def onward(self, cost: np.ndarray, free: float) -> tuple[np.ndarray, np.ndarray]:
        """Least cost of reaching each speed, and the slowest speed that it comes from."""
        step, from_grid = self.by_distance(free)
        first = (cost + from_grid).argmin(axis=1)
        low, high = (np.minimum(first[:-1], first[1:]), np.maximum(first[:-1], first[1:])) if len(first) > 1 else (first, first)
        wide = int((high - low).max()) + 1
        if wide * 4 <= self.top:
            source = np.minimum(low[self.part][:, None] + self.speeds[:wide], self.top - 1)
            total = cost[source] + step[np.abs(self.speeds[:, None] - source)]
            best = total.argmin(axis=1)
            return total[self.speeds, best], source[self.speeds, best]
        out, chosen = np.empty(self.top), np.empty(self.top, np.int64)
        for a, b, lo, hi in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), low.tolist(), high.tolist()):
            total = cost[lo : hi + 1] + step[np.abs(self.speeds[a:b, None] - self.speeds[lo : hi + 1])]
            best = total.argmin(axis=1)
            out[a:b], chosen[a:b] = total[self.speeds[: b - a], best], best + lo
        return out, chosen


def cheapest_path(mid: np.ndarray, raw: np.ndarray, fill: np.ndarray, anchor: np.ndarray, p: Params, lattice: Lattice | None = None) -> np.ndarray:
    """Speed of each row on the cheapest path; NaN stands for no value. Of equal paths the slower one is taken.

    ``lattice`` keeps the step costs from call to call.
    """
    lattice = lattice or Lattice(p)
    top, speeds, fps, n = lattice.top, lattice.speeds, max(p.fps, 1.0), len(mid)

    def observed(k):
        for aim in (fill[k], raw[k]):
            if not math.isnan(aim) and aim > 0:
                return p.observation_weight * np.minimum(1.0, np.abs(speeds - aim) / max(1.0, abs(aim)))
        return np.full(top, p.observation_weight)

    def advance(k, cost, at):
        """Costs after row k, and where it comes from: by speed, or one speed for all.

        An anchor leaves one state open, ``at``; a step from or to it needs no more than one speed's costs.
        """
        dt = (mid[k] - mid[k - 1]) / fps
        free = min(p.max_accel * (dt if dt > 0 else 1.0 / fps) * KMH_PER_MS, p.max_step)
        if anchor[k]:
            to = int(raw[k])
            if at is None:
                total = cost + lattice.by_distance(free)[0][np.abs(speeds - to)]
                best = int(total.argmin())
                return total[best] + p.anchor_cost, to, best
            return cost + lattice.by_distance(free)[0][abs(to - at)] + p.anchor_cost, to, at
        if at is None:
            total, chosen = lattice.onward(cost, free)
            return total + observed(k), None, chosen.astype(np.int16 if top < 1 << 15 else np.int32)
        return cost + lattice.by_distance(free)[0][np.abs(speeds - at)] + observed(k), None, at

    cost, at = (p.anchor_cost, int(raw[0])) if anchor[0] else (observed(0), None)
    begins, choices = [(cost, at)], []
    for k in range(1, n):
        if (k - 1) % BLOCK_ROWS == 0 and k > 1:
            begins.append((cost, at))
            choices = []
        cost, at, chosen = advance(k, cost, at)
        choices.append(chosen)
    path = np.empty(n, np.int64)
    path[-1] = state = int(cost.argmin()) if at is None else at
    for block in range(len(begins) - 1, -1, -1):
        first = block * BLOCK_ROWS + 1
        if block < len(begins) - 1:
            (cost, at), choices = begins[block], []
            for k in range(first, first + BLOCK_ROWS):
                cost, at, chosen = advance(k, cost, at)
                choices.append(chosen)
        for k in range(first + len(choices) - 1, first - 1, -1):
            chosen = choices[k - first]
            path[k - 1] = state = int(chosen if np.ndim(chosen) == 0 else chosen[state])
    return path


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold whole groups of equal keys; rows come ordered by them. An open group is copied once."""
    held: list[pa.RecordBatch] = []

    def joined():
        table = pa.Table.from_batches(held)
        held.clear()
        return table.combine_chunks().to_batches()[0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        here = tuple(c[0] for c in columns)
        at = 0
        if held and here != last:
            yield joined()
        elif held and len(cuts):
            held.append(batch.slice(0, cuts[0]))
            at = int(cuts[0])
            yield joined()
        end = int(cuts[-1]) if len(cuts) else 0
        if end > at:
            yield batch.slice(at, end - at)
        held.append(batch.slice(max(end, at)))
        last = tuple(c[-1] for c in columns)
    if held:
        yield joined()


def smooth(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds corr: readings moved onto the cheapest path where they are missing or far from it. Needs anchor and fill.

    A reading above ``max_speed`` is no anchor here: it would leave no path at all. Rows pass through
    the solver with all their columns, so the chain that made them is computed once.
    """
    keep = [c for c in df.columns if c != "corr"]
    usable = F.col("anchor") & F.col("raw").isNotNull() & F.col("raw").between(0, int(p.max_speed))
    before = run_order().rowsBetween(Window.unboundedPreceding, -1)
    marked = df.select(*keep, usable.alias("_a"))
    # a stretch is the rows after one anchor up to the next, which closes it
    marked = marked.withColumn("_k", F.coalesce(F.sum(F.col("_a").cast("int")).over(before), F.lit(0)).cast("int")).withColumn("_next", F.lead("_a").over(run_order()))
    # an anchor before rows that are none also opens their stretch, as a row that is not given back
    opens = F.col("_a") & ~F.coalesce("_next", F.lit(True))
    own = F.struct(F.col("_k").alias("stretch"), F.lit(True).alias("own"))
    again = F.struct((F.col("_k") + 1).alias("stretch"), F.lit(False).alias("own"))
    rows = marked.withColumn("_in", F.explode(F.when(opens, F.array(own, again)).otherwise(F.array(own)))).select(*keep, "_a", "_in.stretch", "_in.own")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(p)
        for now in _whole(batches, ["run_id", "stretch"]):
            number = lambda c: now.column(c).to_numpy(zero_copy_only=False).astype(float)
            run, stretch = (now.column(c).to_numpy(zero_copy_only=False) for c in ("run_id", "stretch"))
            cuts = [0, *(np.flatnonzero((run[1:] != run[:-1]) | (stretch[1:] != stretch[:-1])) + 1), now.num_rows]
            mid, raw, fill = (number(c) for c in ("mid", "raw", "fill"))
            fixed = now.column("_a").to_numpy(zero_copy_only=False).astype(bool)
            path = np.where(fixed, 0, -1)
            for a, b in zip(cuts, cuts[1:]):
                if not fixed[a:b].all():
                    path[a:b] = cheapest_path(mid[a:b], raw[a:b], fill[a:b], fixed[a:b], p, lattice)
            free = pa.array(path, pa.int32(), mask=fixed)
            yield pa.RecordBatch.from_arrays([*now.select(keep).columns, free], [*keep, "_path"]).filter(now.column("own"))

    dealt = rows.repartition("run_id", "stretch").sortWithinPartitions("run_id", "stretch", "seg")
    solved = dealt.mapInArrow(solve, T.StructType([*df.select(keep).schema.fields, T.StructField("_path", T.IntegerType())]))
    commit = F.col("_path").isNotNull() & (F.col("raw").isNull() | (F.abs(F.col("_path") - F.col("raw")) > p.change_threshold))
    return solved.select(*keep, F.when(commit, F.col("_path")).otherwise(F.col("raw")).alias("corr"))
