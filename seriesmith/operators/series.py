"""Operators on ordered series: detection, scoring and repair of readings.

Every function takes rows with run_id, seg (order), mid (time), len (frames) and raw (reading or
null) and adds columns. All windows are partitioned by run_id, so a chain of them shares one shuffle;
they are ordered by seg, but for the window in time about a row and the search for what comes next.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.functions.numeric import array_median, lerp
from seriesmith.params import DEFAULTS, KMH_PER_MS, Params


def run_order():
    """Window over each run in order."""
    return Window.partitionBy("run_id").orderBy("seg")


def whole_run():
    return Window.partitionBy("run_id")


def _rows(a: int, b: int):
    return run_order().rowsBetween(a, b)


def half_width(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds _half: ``window`` times the run's median gap in time, at most ``window_max``; and _pm, the time of the row before."""
    gap = F.percentile(F.col("mid") - F.col("_pm"), F.lit(0.5)).over(whole_run())
    width = F.least(F.lit(p.window) * F.greatest(F.coalesce("_gap", F.lit(1.0)), F.lit(1.0)), F.lit(float(p.window_max)))
    return df.withColumn("_pm", F.lag("mid").over(run_order())).withColumn("_gap", gap).withColumn("_half", width).drop("_gap")


class _Medians:
    """Medians of steps in a window of time that moves forward over one run; only what the window holds is kept."""

    def __init__(self, half: float):
        self.half = half
        self.rows: deque = deque()  # times of rows that wait for their median
        self.ahead: deque = deque()  # steps that no window has reached yet: time, begin, size
        self.inside: list[float] = []  # sizes in order
        self.leaving: list[tuple] = []  # begin and size, a heap

    def add(self, mid, begin, size) -> list[float]:
        """Take the next row in time; the medians of the rows whose windows it ends."""
        done = self.upto(mid)
        self.rows.append(mid)
        if mid is not None and begin is not None and size is not None:
            self.ahead.append((mid, min(mid, begin), float(size)))
        return done

    def upto(self, mid) -> list[float]:
        """Medians of waiting rows whose windows end before ``mid``; of all for None at the end."""
        out = []
        while self.rows and (self.rows[0] is None or mid is None or mid - self.rows[0] > self.half):
            out.append(self._median(self.rows.popleft()))
        return out

    def _median(self, mid) -> float:
        if mid is None:
            return 0.0
        inside, leaving = self.inside, self.leaving
        while self.ahead and self.ahead[0][0] - mid <= self.half:
            _, begin, size = self.ahead.popleft()
            insort(inside, size)
            heappush(leaving, (begin, size))
        while leaving and leaving[0][0] < mid - self.half:
            del inside[bisect_left(inside, heappop(leaving)[1])]
        n = len(inside)
        return (inside[(n - 1) // 2] + inside[n // 2]) / 2.0 if n else 0.0


def _bandwidths(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by run and time; a batch goes on once the windows of its rows are complete."""
        waiting: deque = deque()
        found: list[float] = []
        key, medians = None, None

        def ready():
            nonlocal found
            while waiting and len(found) >= waiting[0].num_rows:
                batch = waiting.popleft()
                yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(found[: batch.num_rows], pa.float64())], [*keep, "bw"])
                found = found[batch.num_rows :]

        for batch in batches:
            waiting.append(batch)
            for this, mid, begin, size, half in zip(*(batch.column(c).to_pylist() for c in ("run_id", "mid", "_pm", "_dv", "_half"))):
                if medians is None or this != key:
                    if medians is not None:
                        found += medians.upto(None)
                    key, medians = this, _Medians(half)
                found += medians.add(mid, begin, size)
            yield from ready()
        if medians is not None:
            found += medians.upto(None)
        yield from ready()

    return run


def local_bandwidth(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds bw: median step between neighbouring readings inside a time window about each row, 0 if none.

    Both ends of a step must be inside. The half-width is ``window`` times the run's median gap, at most
    ``window_max``. The rows of a run are read once in order of time, with the steps of one window
    in order of size: work and memory follow the rows of a window, which a frame of literal bounds would list for every row.
    """
    keep = [c for c in df.columns if c != "bw"]
    rows = half_width(df.select(*keep), p).withColumn("_dv", F.abs(F.col("raw") - F.lag("raw").over(run_order())))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("bw", T.DoubleType())])
    return rows.sortWithinPartitions("run_id", "mid", "seg").mapInArrow(_bandwidths(keep), schema)


def context(df: DataFrame, p: Params) -> DataFrame:
    """Adds _med, _n, _nl and _nr: median and number of readings about each row, and the number on each side."""
    k = p.neighbours
    return (
        df.withColumn("_med", F.percentile("raw", F.lit(0.5)).over(_rows(-k, k)))
        .withColumn("_n", F.count("raw").over(_rows(-k, k)))
        .withColumn("_nl", F.count("raw").over(_rows(-k, -1)))
        .withColumn("_nr", F.count("raw").over(_rows(1, k)))
    )


def detect(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds suspect: the reading is missing, has too few neighbours, or is far from their median. Needs bw."""
    floor = F.when(F.col("len") == 1, p.single_floor).otherwise(p.floor)
    far = F.abs(F.col("raw") - F.col("_med")) > F.greatest("bw", floor) * p.multiplier
    out = F.when(F.col("raw").isNull() | (F.col("_n") < p.least_neighbours), True).when((F.col("_nl") == 0) | (F.col("_nr") == 0), False).otherwise(far)
    return context(df, p).withColumn("suspect", out).drop("_med", "_n", "_nl", "_nr")


def next_value(of: Column, by: list[str], *order: Column):
    """The first value of ``of`` that is not null after each row in the order of ``order``.

    Looked for as the last one before it in the order turned round: such a frame grows row by row, while
    one that ends with the run would be read again for every row.
    """
    return F.last(of, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def nearest_anchors(df: DataFrame, ok: Column, time: str = "mid", value: str = "raw") -> DataFrame:
    """Adds _l and _r: time and value of the nearest row before and after for which ``ok`` holds."""
    point = F.when(ok, F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    return df.withColumn("_l", F.last(point, ignorenulls=True).over(_rows(Window.unboundedPreceding, -1))).withColumn(
        "_r", next_value(point, ["run_id"], F.col("seg").desc())
    )


def anchor_value(p: Params) -> Column:
    """Line through _l and _r at mid; one side alone gives its value; a side further than anchor_max is none."""
    left = F.when(F.col("mid") - F.col("_l.t") <= p.anchor_max, F.col("_l"))
    right = F.when(F.col("_r.t") - F.col("mid") <= p.anchor_max, F.col("_r"))
    both = lerp(F.col("mid"), left["t"], left["v"].cast("double"), right["t"], right["v"].cast("double"))
    return F.when(left.isNotNull() & right.isNotNull(), both).otherwise(F.coalesce(left["v"], right["v"]).cast("double"))


def correct(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds fixed: suspects moved onto the line between the nearest good readings if that is far enough. Needs suspect."""
    out = nearest_anchors(df, ~F.col("suspect") & F.col("raw").isNotNull())
    line = anchor_value(p)
    use = F.col("suspect") & line.isNotNull() & (F.col("raw").isNull() | (F.abs(line - F.col("raw")) > p.min_deviation))
    return out.withColumn("fixed", F.when(use, F.bround(line, 0).cast("int")).otherwise(F.col("raw"))).drop("_l", "_r")


def confidence(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds conf in 0..100 and branch, the rule that gave it. Needs bw."""
    by_median = F.lit(100.0) * F.exp(-F.abs(F.col("raw") - F.col("_med")) / F.greatest("bw", F.lit(p.floor)))
    jerk = F.abs(F.lead("raw").over(run_order()) - 2 * F.col("raw") + F.lag("raw").over(run_order()))
    by_jerk = F.lit(p.weight_median) * F.col("_ms") + F.lit(p.weight_jerk) * 100.0 * F.exp(-F.col("_jerk") / p.jerk_scale)
    rules = [
        (F.col("raw").isNull(), F.lit(0.0), "none"),
        (F.col("_n") < p.least_neighbours, F.lit(p.short_confidence), "sparse"),
        ((F.col("_nl") == 0) | (F.col("_nr") == 0), F.lit(p.edge_confidence), "edge"),
        (F.col("_ms") >= p.median_gate, F.col("_ms"), "fit"),
        (F.col("_jerk").isNotNull(), by_jerk, "jerk"),
    ]
    conf, branch = F.col("_ms"), F.lit("fit")
    for when, value, name in reversed(rules):
        conf, branch = F.when(when, value).otherwise(conf), F.when(when, name).otherwise(branch)
    return (
        context(df, p).withColumn("_ms", by_median).withColumn("_jerk", jerk).withColumn("conf", conf).withColumn("branch", branch)
        .drop("_med", "_n", "_nl", "_nr", "_ms", "_jerk")
    )


def anchors(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds anchor: trusted readings, without those of middling trust that jerk against both neighbours. Needs conf."""
    jerk = F.abs(F.lead("raw").over(run_order()) - 2 * F.col("raw") + F.lag("raw").over(run_order()))
    base = F.col("raw").isNotNull() & (F.col("conf") >= p.anchor_confidence)
    drop = F.lit(p.deanchor_jerk_min > 0) & (F.col("conf") < p.deanchor_confidence) & F.coalesce(jerk.between(p.deanchor_jerk_min, p.deanchor_jerk_max), F.lit(False))
    return df.withColumn("anchor", base & ~drop)


def fill_curve(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds fill: the line between the nearest anchors, for every row. Needs anchor."""
    return nearest_anchors(df, F.col("anchor")).withColumn("fill", anchor_value(p)).drop("_l", "_r")


def spike_pass(df: DataFrame, corrected: str = "corr", p: Params = DEFAULTS) -> DataFrame:
    """Adds spiked: single-frame readings that stand out against both sides take the further side's median.

    Only readings that nothing has changed yet, of one frame, whose value does not recur nearby.
    """
    k = p.spike_reach
    base = F.coalesce(F.col(corrected), F.col("raw"))
    near = lambda a, b: _rows(a, b)
    out = (
        df.withColumn("_b", base)
        .withColumn("_ml", F.percentile("_b", F.lit(0.5)).over(near(-k, -1)))
        .withColumn("_mr", F.percentile("_b", F.lit(0.5)).over(near(1, k)))
        .withColumn("_cl", F.count("_b").over(near(-k, -1)))
        .withColumn("_cr", F.count("_b").over(near(1, k)))
        .withColumn("_around", F.concat(F.collect_list("_b").over(near(-k, -1)), F.collect_list("_b").over(near(1, k))))
        .withColumn("_dl", F.col("_b") - F.col("_ml"))
        .withColumn("_dr", F.col("_b") - F.col("_mr"))
    )
    target = F.bround(F.when(F.abs("_dl") >= F.abs("_dr"), F.col("_ml")).otherwise(F.col("_mr")), 0).cast("int")
    untouched = F.col("raw").isNotNull() & (F.col("len") == 1) & (F.col(corrected).isNull() | (F.col(corrected) == F.col("raw")))
    hit = (
        untouched
        & (F.col("_cl") >= p.spike_neighbours)
        & (F.col("_cr") >= p.spike_neighbours)
        & (F.col("_dl") * F.col("_dr") > 0)
        & (F.greatest(F.abs("_dl"), F.abs("_dr")) >= p.spike_threshold)
        & ~F.array_contains("_around", F.col("_b"))
        & (F.abs(target - F.col("_b")) >= p.spike_min_fix)
    )
    return out.withColumn("spiked", F.when(F.coalesce(hit, F.lit(False)), target).otherwise(F.col(corrected))).drop("_b", "_ml", "_mr", "_cl", "_cr", "_around", "_dl", "_dr")


def distance(df: DataFrame, frame: str = "frame", speed: str = "speed", fps: float = 30.0) -> DataFrame:
    """Adds dist: metres run up to each frame, the left speed held over each step; rows without a speed (-1) add nothing."""
    order = Window.partitionBy("run_id").orderBy(frame)
    step = F.lag(speed).over(order) / KMH_PER_MS * (F.col(frame) - F.lag(frame).over(order)) / fps
    return (
        df.withColumn("_step", F.when(F.col(speed) >= 0, F.coalesce(step, F.lit(0.0))).otherwise(0.0))
        .withColumn("dist", F.bround(F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2))
        .drop("_step")
    )


def trim_start(df: DataFrame, order: str = "idx", speed: str = "speed", rebase: tuple[str, ...] = ("t", "dist")) -> DataFrame:
    """Drops rows before a run's first positive speed, if there is one, and counts the named columns from the first row left."""
    out = df.withColumn("_from", F.min(F.when(F.col(speed) > 0, F.col(order))).over(whole_run())).where(F.col("_from").isNull() | (F.col(order) >= F.col("_from"))).drop("_from")
    first = Window.partitionBy("run_id").orderBy(order)
    return out.withColumns({c: F.col(c) - F.first(c).over(first) for c in rebase})


def rotate(df: DataFrame, offset: int, order: str = "idx") -> DataFrame:
    """Adds at: the position of each row after the run is rotated by ``offset``."""
    n = F.count(F.lit(1)).over(whole_run())
    return df.withColumn("at", F.pmod(F.col(order) + F.lit(offset), n).cast("int"))


def lap_base(df: DataFrame, x: str, lap: str, order: str = "at") -> DataFrame:
    """Adds x_lap: x counted from the first row of the order, modulo the lap's length."""
    return df.withColumn("x_lap", F.pmod(F.col(x) - F.first(x).over(Window.partitionBy("run_id").orderBy(order)), F.col(lap)))


def islands_of(df: DataFrame, key: Column, order: str = "seg", name: str = "island") -> DataFrame:
    """Adds a number for each maximal run of rows with an equal key, from 0."""
    w = Window.partitionBy("run_id").orderBy(order)
    change = F.when(F.row_number().over(w) == 1, 0).otherwise((~key.eqNullSafe(F.lag(key).over(w))).cast("int"))
    return df.withColumn("_c", change).withColumn(name, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_c")


def cut_at(df: DataFrame, boundary: Column, order: str = "frame", name: str = "seg") -> DataFrame:
    """Change-point segmentation: each boundary row begins a new segment; the first row begins segment 0."""
    w = Window.partitionBy("run_id").orderBy(order)
    starts = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(boundary, F.lit(False)).cast("int"))
    return df.withColumn("_b", starts).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")


def roll_up(df: DataFrame, frame: str = "frame", score: str = "sharp") -> DataFrame:
    """Frames with seg to segments: start, end, n, mid (upper middle frame), rep (best score, earliest on ties)."""
    frames = F.sort_array(F.collect_list(frame))
    return (
        df.groupBy("run_id", "seg")
        .agg(
            F.min(frame).alias("start"),
            F.max(frame).alias("end"),
            F.count(F.lit(1)).cast("int").alias("n"),
            frames.alias("frames"),
            F.max_by(F.col(frame), F.struct(F.col(score), -F.col(frame))).alias("rep"),
        )
        .withColumn("mid", F.get("frames", F.floor(F.col("n") / 2).cast("int")))
    )


def progress_gate(df: DataFrame, order: str = "seg", percent: str = "pct", phase: str = "phase") -> DataFrame:
    """Rows that advance: percent above all accepted before, or equal with a later phase."""
    w = Window.partitionBy("run_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    now = F.struct(F.col(percent), F.col(phase))
    return df.withColumn("_best", F.max(now).over(w)).where(F.col("_best").isNull() | (now > F.col("_best"))).drop("_best")


def pair_accelerations(df: DataFrame, fps: float = 30.0) -> DataFrame:
    """Adds accel: change per second since the row before; a time step of zero or less is one frame."""
    dt = (F.col("mid") - F.lag("mid").over(run_order())) / fps
    return df.withColumn("accel", (F.col("raw") - F.lag("raw").over(run_order())) / F.when(dt <= 0, 1.0 / fps).otherwise(dt))


def jump_islands(df: DataFrame, p: Params = DEFAULTS, mult: float = 1.0, look: int = 15) -> DataFrame:
    """Adds jumped: rows that jump faster than physics allows, or lie between opposite jumps within ``look`` rows."""
    d = F.col("raw") - F.lag("raw").over(run_order())
    dt = F.abs(F.col("mid") - F.lag("mid").over(run_order())) / max(p.fps, 1.0)
    over = F.abs(d) > F.lit(p.max_accel) * dt * KMH_PER_MS * mult
    sign = F.when(over, F.signum(d.cast("double")))
    out = (
        df.withColumn("_s", sign)
        .withColumn("_ls", F.last("_s", ignorenulls=True).over(_rows(-look, -1)))
        .withColumn("_rs", F.first("_s", ignorenulls=True).over(_rows(1, look)))
    )
    between = F.coalesce(F.col("_ls") != F.col("_rs"), F.lit(False))
    return out.withColumn("jumped", F.col("raw").isNotNull() & (F.col("_s").isNotNull() | between)).drop("_s", "_ls", "_rs")


def sliding(df: DataFrame, column: str, half: int, kind: str = "median", name: str = "smooth") -> DataFrame:
    """Sliding median or mean of 2*half+1 rows, the first and last value repeated beyond the ends."""
    n = F.count(F.lit(1)).over(whole_run())
    rn = F.row_number().over(run_order())
    ends = Window.partitionBy("run_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.collect_list(F.col(column).cast("double")).over(_rows(-half, half))
    out = (
        df.withColumn("_in", inside)
        .withColumn("_before", F.greatest(F.lit(0), F.lit(half + 1) - rn).cast("int"))
        .withColumn("_after", F.greatest(F.lit(0), F.lit(half) - (n - rn)).cast("int"))
        .withColumn("_f", F.first(F.col(column).cast("double")).over(ends))
        .withColumn("_z", F.last(F.col(column).cast("double")).over(ends))
        .withColumn("_all", F.concat(F.array_repeat("_f", F.col("_before")), F.col("_in"), F.array_repeat("_z", F.col("_after"))))
    )
    mean = F.aggregate("_all", F.lit(0.0), lambda a, x: a + x) / (2 * half + 1)
    return out.withColumn(name, array_median(F.col("_all")) if kind == "median" else mean).drop("_in", "_before", "_after", "_f", "_z", "_all")


def savgol_coefficients(window: int, order: int) -> list[float]:
    """Weights of a Savitzky-Golay filter at the window's middle."""
    import numpy as np

    if window % 2 == 0 or window <= order:
        raise ValueError("the window must be odd and longer than the order")
    half = window // 2
    x = np.arange(-half, half + 1, dtype=float)
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0].tolist()


def savgol(df: DataFrame, column: str, window: int = 7, order: int = 3, name: str = "smooth") -> DataFrame:
    """Savitzky-Golay smoothing; the first and last half-window take the nearest full result; short runs stay as they are."""
    half = window // 2
    weights = savgol_coefficients(window, order)
    total = None
    for k, c in enumerate(weights):
        term = F.lit(c) * F.lag(F.col(column), half - k).over(run_order())
        total = term if total is None else total + term
    rn, n = F.row_number().over(run_order()), F.count(F.lit(1)).over(whole_run())
    ends = run_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("_s", total).withColumn("_rn", rn).withColumn("_n", n)
    out = out.withColumn("_a", F.first("_s", ignorenulls=True).over(ends)).withColumn("_z", F.last("_s", ignorenulls=True).over(ends))
    value = F.when(F.col("_n") < window, F.col(column).cast("double")).when(F.col("_rn") <= half, F.col("_a")).when(F.col("_rn") > F.col("_n") - half, F.col("_z")).otherwise(F.col("_s"))
    return out.withColumn(name, value).drop("_s", "_rn", "_n", "_a", "_z")


def smoothing_window(n: Column, strength: Column, p: Params = DEFAULTS) -> Column:
    """Odd window length for a strength in percent; null where nothing is smoothed."""
    w = F.least(F.greatest((n * strength / 100 * p.smooth_factor).cast("int"), F.lit(p.smooth_least)), n - 2)
    return F.when((strength > 0) & (n >= p.smooth_least), F.when(w % 2 == 0, F.greatest(w - 1, F.lit(3))).otherwise(w))


def region_statistics(df: DataFrame, t: str = "t", x: str = "dist", v: str = "speed", order: str = "idx") -> DataFrame:
    """Per run: metres under the speed curve, and seconds over the distance axis."""
    w = Window.partitionBy("run_id").orderBy(order)
    mean = (F.col(v) + F.lag(v).over(w)) / 2.0
    dt, dx = F.col(t) - F.lag(t).over(w), F.col(x) - F.lag(x).over(w)
    steps = df.select("run_id", (mean / KMH_PER_MS * dt).alias("m"), F.when((mean > 0) & (dx > 0), dx / (mean / KMH_PER_MS)).alias("s"))
    return steps.groupBy("run_id").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("metres"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("seconds"))


def physics_check(df: DataFrame, value: str = "raw", p: Params = DEFAULTS) -> DataFrame:
    """Adds plausible: the step to each neighbour is within what acceleration allows, with tolerance."""
    gap = lambda a: F.greatest(F.abs(a) / p.fps, F.lit(1e-3))
    step = F.greatest(F.abs(F.col(value) - F.lag(value).over(run_order())), F.abs(F.col(value) - F.lead(value).over(run_order())))
    dt = F.least(gap(F.col("mid") - F.lag("mid").over(run_order())), gap(F.lead("mid").over(run_order()) - F.col("mid")))
    return df.withColumn("plausible", F.coalesce(step <= F.lit(p.max_accel * KMH_PER_MS) * dt * p.review_tolerance, F.lit(True)))


def runs(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per run: its segments, frames, and duration in seconds."""
    frames = F.sum("len").cast("long")
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("segments"), frames.alias("frames"), (frames / F.lit(float(p.fps))).alias("duration"))


def run_digests(df: DataFrame, value: Column, order: str = "seg") -> DataFrame:
    """SHA-256 of each run's values in order, as lines of order and value; one row of a run's text in memory at a time."""
    line = F.concat(F.col(order).cast("string"), F.lit(":"), value)
    rows = df.select("run_id", F.struct(F.col(order).alias("o"), line.alias("x")).alias("r")).groupBy("run_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return rows.select("run_id", F.sha2(F.array_join("r.x", "\n"), 256).alias("digest"))
