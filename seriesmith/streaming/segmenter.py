"""Incremental segmentation of a stream of frames, one state per run.

A segment is emitted when it closes, which is when a later frame differs; what is open at the end of
the input closes at a frame that is marked last. Inside a micro-batch frames are put in order; a
frame at or before the last one seen is late and is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns beside the run id, which is of any type.
OUTPUT = "seg int, start int, end int, n int, rep int, value int"
STATE = "seg int, start int, end int, n int, rep int, sharp double, value int"


def close_segments(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows: frame, value, sharp, last. Keeps the open segment: number, bounds, count, sharpest frame, value."""
    frames = pd.concat(list(batches)).sort_values("frame", kind="stable")
    now = state.get if state.exists else None
    done = []
    for frame, value, sharp, last in zip(frames["frame"], frames["value"], frames["sharp"], frames["last"]):
        if now is not None and frame <= now[2]:
            continue
        if now is None or value != now[6]:
            if now is not None:
                done.append(now)
            now = (0 if now is None else now[0] + 1, frame, frame, 1, frame, sharp, value)
        else:
            seg, start, _, n, rep, best, _ = now
            now = (seg, start, frame, n + 1, frame if sharp > best else rep, max(best, sharp), value)
        if last:
            done.append(now)
            now = None
            break
    if now is None:
        if state.exists:
            state.remove()
    else:
        state.update(tuple(x.item() if hasattr(x, "item") else x for x in now))
    yield pd.DataFrame([(key[0], *d[:5], d[6]) for d in done], columns=["run_id", "seg", "start", "end", "n", "rep", "value"])


def segment_stream(frames: DataFrame) -> DataFrame:
    """frames: run_id, frame, value, sharp, last. The same rows batch or stream."""
    return frames.groupBy("run_id").applyInPandasWithState(close_segments, f"run_id {frames.schema['run_id'].dataType.simpleString()}, {OUTPUT}", STATE, "append", GroupStateTimeout.NoTimeout)
