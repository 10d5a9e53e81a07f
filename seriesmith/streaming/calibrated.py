"""Segmentation of a stream of pictures whose threshold is found first: one state per run.

The first frames of a run wait in the state until there are enough of them to calibrate. Their own
thresholds' median becomes the run's; then they are replayed and later frames follow directly. A frame
opens a segment if enough pixels differ from the frame before once both are binarised. Frames are numbered
from 0 without gaps; one that comes before its turn waits until the frames before it have come. With
``patience_ms`` a timer gives up on missing frames: what waits is taken as it is, in order.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from seriesmith.params import DEFAULTS

CALIBRATION_FRAMES = 50
#: Pixels that change between two segments, as a share of all.
CHANGE = 0.4
OUTPUT = "seg int, start int, end int, n int, threshold int"
_FRAME = "frame int, px array<int>, last boolean"
_OPEN = "next int, threshold int, seg int, start int, end int, n int, px array<int>, done boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def otsu_threshold(px: np.ndarray, fallback: int = DEFAULTS.otsu_fallback) -> int:
    """The gray whose classes have the greatest variance between them, to four digits; the first of equal ones."""
    counts = np.bincount(px, minlength=256).astype(np.int64)
    n, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    total, whole = n[-1], mass[-1]
    at = np.flatnonzero((counts > 0) & (n < total))
    if not len(at):
        return fallback
    between = n[at].astype(float) * (total - n[at]) * (mass[at] / n[at] - (whole - mass[at]) / (total - n[at])) ** 2
    return int(at[np.argmax(np.round(between, 4))])


class Segmenter(StatefulProcessor):
    """Holds waiting frames in a list and the open segment in a value; see the module."""

    def __init__(self, calibration: int = CALIBRATION_FRAMES, change: float = CHANGE, patience_ms: int | None = None, clock=time.time):
        self.calibration, self.change, self.patience_ms, self.clock = calibration, change, patience_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _FRAME)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(f), px, bool(last)) for part in rows for f, px, last in zip(part["frame"], part["px"], part["last"])]
        yield self._advance(key, new, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], True)

    def close(self) -> None:
        pass

    def _advance(self, key, new: list, impatient: bool) -> pd.DataFrame:
        now = list(self.open.get() or ()) or [0, None, 0, None, None, 0, None, False]
        if now[7]:  # the run has ended; late frames are dropped
            return self._rows(key, [], now)
        held: dict[int, tuple] = {}
        for f, px, last in [*((f, px, last) for f, px, last in self.waiting.get()), *new]:
            if f >= now[0]:
                held.setdefault(f, (np.asarray(px, dtype=np.int64), last))  # of repeated frames the first counts
        order, ready, at = sorted(held), [], now[0]
        for f in order:
            if f != at and not impatient:
                break
            ready.append(f)
            at = f + 1
        done: list[tuple] = []
        ended = any(held[f][1] for f in ready)
        if now[1] is None and (len(ready) >= self.calibration or ended or (impatient and ready)):
            now[1] = int(np.median([otsu_threshold(held[f][0]) for f in ready[: self.calibration]]))
        if now[1] is not None:
            for f in ready:
                px, last = held.pop(f)
                self._take(now, f, px > now[1], done)
                if last:
                    self._close(now, done)
                    now[7] = True
                    held.clear()
                    break
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer(int(self.clock() * 1000) + self.patience_ms)
        if held:
            self.waiting.put([(f, px.tolist(), last) for f, (px, last) in sorted(held.items())])
        else:
            self.waiting.clear()
        self.open.update(tuple(now))
        return self._rows(key, done, now)

    def _take(self, now: list, frame: int, mask: np.ndarray, done: list) -> None:
        before = None if now[6] is None else np.asarray(now[6], dtype=bool)
        if before is not None and (before.shape != mask.shape or (before != mask).mean() >= self.change):
            self._close(now, done)
        if now[3] is None:
            now[3], now[5] = frame, 0
        now[4], now[5], now[6], now[0] = frame, now[5] + 1, mask.astype(int).tolist(), frame + 1

    @staticmethod
    def _close(now: list, done: list) -> None:
        done.append((now[2], now[3], now[4], now[5]))
        now[2], now[3], now[4], now[5] = now[2] + 1, None, None, 0

    @staticmethod
    def _rows(key, done: list, now: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *d, now[1]) for d in done], columns=["run_id", "seg", "start", "end", "n", "threshold"])


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What such state needs; to be set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def segment_pictures(frames: DataFrame, processor: Segmenter | None = None) -> DataFrame:
    """frames: run_id (of any type), frame, px, last. Segments as they close; the same rows however batches are cut.

    A processor with patience is for queries that go on: one that ends with what is available never
    ends while timers may fire.
    """
    processor = processor or Segmenter()
    keep_state_in_rocksdb(frames.sparkSession)
    schema = StructType([StructField("run_id", frames.schema["run_id"].dataType), *StructType.fromDDL(OUTPUT).fields])
    rows = frames.select("run_id", "frame", "px", "last")
    return rows.groupBy("run_id").transformWithStateInPandas(processor, schema, "Append", "None" if processor.patience_ms is None else "ProcessingTime")
