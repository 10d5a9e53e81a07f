"""Calibrated segments, the append-only log, late rows and joins of streams."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import pixels
from seriesmith.streaming import calibrated, run_log, windows


class Held:
    """State of one key, as the engine keeps it."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], []

    def getListState(self, name, schema):
        outer = self

        class List:
            get = staticmethod(lambda: iter(outer.rows))
            put = staticmethod(lambda rows: setattr(outer, "rows", rows))
            clear = staticmethod(lambda: setattr(outer, "rows", []))

        return List

    def getValueState(self, name, schema):
        outer = self

        class Value:
            get = staticmethod(lambda: outer.value)
            update = staticmethod(lambda v: setattr(outer, "value", v))

        return Value

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def pictures(n, seed=1):
    rng = np.random.default_rng(seed)
    base, out = rng.integers(0, 256, 36), []
    for _ in range(n):
        if rng.random() < 0.3:
            base = rng.integers(0, 256, 36)
        out.append(base.tolist())
    return out


def fed(frames, cuts, processor=None, order=None):
    """Rows that a run yields if its frames come in the given batches."""
    p, state, out = processor or calibrated.Segmenter(10), Held(), []
    p.init(state)
    rows = [(k, px, k == len(frames) - 1) for k, px in enumerate(frames)]
    rows = rows if order is None else [rows[k] for k in order]
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        part = pd.DataFrame(rows[a:b], columns=["frame", "px", "last"])
        for got in p.handleInputRows(("r",), iter([part.iloc[:3], part.iloc[3:]]), None):
            out += list(got.itertuples(index=False, name=None))
    return out, state


def plain(frames, calibration=10):
    threshold = int(np.median([calibrated.otsu_threshold(np.array(px)) for px in frames[:calibration]]))
    masks = [np.array(px) > threshold for px in frames]
    starts = [0] + [k for k in range(1, len(frames)) if (masks[k] != masks[k - 1]).mean() >= calibrated.CHANGE]
    return [("r", s, a, b - 1, b - a, threshold) for s, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)]))]


def test_any_cut_and_any_order_give_the_same_segments():
    frames, rng = pictures(60), np.random.default_rng(2)
    want = plain(frames)
    assert len(want) > 5
    for cuts in ([], [1], [5, 9, 10, 11], list(range(1, 60)), [59]):
        got, state = fed(frames, cuts)
        assert got == want and state.rows == []
        assert fed(frames, cuts, order=rng.permutation(60).tolist())[0] == want


def test_short_runs_and_late_frames():
    frames = pictures(4)
    assert fed(frames, [2])[0] == plain(frames, 4)
    p, state = calibrated.Segmenter(2), Held()
    p.init(state)
    for rows in ([(0, frames[0], False), (1, frames[1], False)], [(0, frames[3], False), (1, frames[3], True)], [(2, frames[2], True)], [(3, frames[3], False)]):
        out = list(p.handleInputRows(("r",), iter([pd.DataFrame(rows, columns=["frame", "px", "last"])]), None))
    assert state.value[7] and not len(out[0])


def test_a_timer_gives_up_on_missing_frames():
    frames = pictures(8)
    p, state = calibrated.Segmenter(3, patience_ms=500, clock=lambda: 10.0), Held()
    p.init(state)
    rows = [(k, frames[k], False) for k in (0, 1, 4, 5)]
    assert not len(next(p.handleInputRows(("r",), iter([pd.DataFrame(rows, columns=["frame", "px", "last"])]), None)))
    assert state.timers == [10_500] and len(state.rows) == 4
    next(p.handleExpiredTimer(("r",), None, None))
    assert state.rows == [] and state.timers == [] and state.value[0] == 6 and state.value[1] is not None


def test_otsu_agrees_with_the_column_operator(spark):
    rows = [(k, px) for k, px in enumerate([*pictures(12, 3), [7] * 36, [0, 255] * 18, [1, 2, 3] * 12])]
    got = pixels.otsu(spark.createDataFrame(rows, "id int, px array<int>"), ["id"])
    assert {r["id"]: r["threshold"] for r in got.collect()} == {k: calibrated.otsu_threshold(np.array(px)) for k, px in rows}


def test_stream_of_pictures_in_three_batches(spark, tmp_path):
    frames = {r: pictures(n, n) for r, n in (("a", 30), ("b", 12))}
    rows = [(r, k, px, k == len(f) - 1) for r, f in frames.items() for k, px in enumerate(f)]
    schema = "run_id string, frame int, px array<int>, last boolean"
    for part in (0, 2, 1):  # parts out of order
        spark.createDataFrame([x for x in rows if x[1] % 3 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = calibrated.segment_pictures(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), calibrated.Segmenter(10))
    run_log.write_log(stream, f"file://{tmp_path}/log", "pictures", f"file://{tmp_path}/c").awaitTermination()
    got = sorted(tuple(r)[:6] for r in run_log.read_log(spark, f"file://{tmp_path}/log", stream.schema).collect())
    assert got == sorted((r, *x[1:]) for r, f in frames.items() for x in plain(f))


def test_a_batch_that_is_tried_again_is_in_the_log_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    one, two = spark.range(5), spark.range(5, 8)
    assert run_log.append_once(one, 0, path, "app") and not run_log.append_once(one, 0, path, "app")
    assert run_log.append_once(two, 1, path, "app") and run_log.append_once(two, 1, path, "other_app")

    class Broken:  # an attempt that writes its rows and breaks off before it commits
        write = two.write

    monkeypatch.setattr(run_log.json, "dumps", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run_log.append_once(Broken, 2, path, "app")
    monkeypatch.undo()
    got = run_log.read_log(spark, path, one.schema)
    assert sorted((r["app"], r["batch"], r["id"]) for r in got.collect()) == sorted([("app", 0, k) for k in range(5)] + [("app", 1, k) for k in (5, 6, 7)] + [("other_app", 1, k) for k in (5, 6, 7)])
    assert run_log.append_once(two, 2, path, "app")
    assert run_log.read_log(spark, f"file://{tmp_path}/none", one.schema).count() == 0


def events(spark, path, parts):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    for k, rows in enumerate(parts):
        spark.createDataFrame([(i, at(m), u, e, 1.0) for i, m, u, e in rows], schema).coalesce(1).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    stream = events(spark, tmp_path / "in", [[(1, 10, 1, "view"), (2, 70, 1, "view")], [(3, 600, 1, "view")], [(8, 601, 1, "view")], [(4, 500, 1, "view"), (5, 20, 1, "view"), (6, 30, 1, "view")], [(7, 2000, 1, "view")]])
    out = windows.tumbling(stream, "1 hour", "2 hours")
    q = run_log.write_log(out, f"file://{tmp_path}/log", "late", f"file://{tmp_path}/c")
    q.awaitTermination()
    got = {r["start"].hour: r["n"] for r in run_log.read_log(spark, f"file://{tmp_path}/log", out.schema).collect()}
    # a batch is held against the watermark that was known when the batch before it began to close windows
    assert got == {0: 1, 1: 1, 8: 1, 10: 2}  # row 4 is within two hours of the latest, rows 5 and 6 are not
    # rows of one group may be summed before the operator drops them
    assert 1 <= windows.dropped_late(q) <= 2


def test_two_streams_joined_within_a_time(spark, tmp_path):
    parts = [[(1, 0, 1, "click"), (2, 5, 2, "click")], [(3, 20, 1, "purchase"), (4, 70, 1, "purchase"), (5, 4, 2, "purchase")], [(6, 30, 2, "purchase"), (7, 31, 2, "view")]]
    out = windows.followed_by(events(spark, tmp_path / "in", parts), "click", "purchase", "1 hour")
    run_log.write_log(out, f"file://{tmp_path}/log", "joined", f"file://{tmp_path}/c").awaitTermination()
    got = run_log.read_log(spark, f"file://{tmp_path}/log", out.schema)
    assert sorted((r["first_id"], r["then_id"], r["wait_us"] // 60_000_000) for r in got.collect()) == [(1, 3, 20), (2, 6, 25)]
