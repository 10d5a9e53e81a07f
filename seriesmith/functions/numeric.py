"""Numbers and small arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmith.params import CORRECTED, FILLED, KMH_PER_MS, PINNED, RAW, TRUSTED, Params

#: km/h in one unit; an explicit conversion, never applied on its own.
KMH = {"km/h": 1.0, "mph": 1.609344, "m/s": KMH_PER_MS}


def to_kmh(value: Column, unit: str) -> Column:
    return value * F.lit(KMH[unit])


def seconds(frame: Column, fps: Column) -> Column:
    """Frame number to seconds; an fps of zero or less counts as one."""
    return frame / F.when(fps > 0, fps).otherwise(1.0)


def frame_rate(average: Column, nominal: Column, p: Params) -> Column:
    """First positive of the two rates, else the default."""
    return F.coalesce(F.when(average > 0, average), F.when(nominal > 0, nominal), F.lit(p.fps))


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Value on the line from (t0, v0) to (t1, v1); halfway when the ends meet."""
    span = t1 - t0
    return v0 + (v1 - v0) * F.when(span > 1e-3, (t - t0) / span).otherwise(0.5)


def array_median(values: Column) -> Column:
    """Median of an array without nulls, the mean of the two middle values of an even number; null if empty."""
    ordered = F.sort_array(values)
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2.0)


def valid_reading(value: Column) -> Column:
    return F.when(value >= 0, value.cast("int"))


def flag(raw: Column, value: Column, confidence: Column, pinned: Column, p: Params) -> Column:
    """Class of a reading: pinned, filled, corrected, trusted or raw, in this order."""
    return (
        F.when(pinned, PINNED)
        .when(raw.isNull(), FILLED)
        .when(value.isNotNull() & (value != raw), CORRECTED)
        .when(confidence >= p.anchor_confidence, TRUSTED)
        .otherwise(RAW)
    )


def is_corrected(flags: Column) -> Column:
    return flags.between(10, 19)


def is_trusted(flags: Column) -> Column:
    return flags.between(20, 29)


def needs_review(read: Column, value: Column) -> Column:
    """A value that is missing, or differs from what was read."""
    return value.isNull() | (read.isNotNull() & (read != value))


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A rectangle kept inside the picture and at least one pixel wide."""
    right, bottom = F.least(F.greatest(x2, F.lit(1)), width - 1), F.least(F.greatest(y2, F.lit(1)), height - 1)
    return F.array(F.least(F.greatest(x1, F.lit(0)), right - 1), F.least(F.greatest(y1, F.lit(0)), bottom - 1), right, bottom)
