"""Every threshold of the series operators, with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # change points
    change_pixels: float = 5.0
    otsu_fallback: int = 127
    calibration_frames: int = 50
    # bandwidth and detection
    window: int = 30
    window_max: int = 120
    neighbours: int = 10
    least_neighbours: int = 3
    multiplier: float = 2.0
    floor: float = 3.0
    single_floor: float = 2.0
    # correction by the nearest trusted readings
    anchor_max: int = 120
    min_deviation: float = 6.0
    # confidence
    weight_median: float = 0.7
    weight_jerk: float = 0.3
    jerk_scale: float = 3.0
    short_confidence: float = 30.0
    edge_confidence: float = 100.0
    median_gate: float = 50.0
    # islands of agreeing readings
    island_tolerance: float = 2.0
    island_frames: int = 5
    island_frames_exact: int = 3
    island_cap: float = 15.0
    island_deviation: float = 3.0
    # smoothing by dynamic programming
    anchor_confidence: float = 20.0
    deanchor_jerk_min: float = 5.0
    deanchor_jerk_max: float = 40.0
    deanchor_confidence: float = 50.0
    observation_weight: float = 1.0
    acceleration_weight: float = 1.0
    max_step: float = 4.0
    anchor_cost: float = 0.1
    change_threshold: float = 3.0
    # spikes
    spike_reach: int = 2
    spike_threshold: float = 2.0
    spike_min_fix: float = 2.0
    spike_neighbours: int = 2
    # physics
    max_speed: float = 400.0
    max_accel: float = 50.0
    fps: float = 30.0
    review_tolerance: float = 3.0
    # curve smoothing
    smooth_factor: float = 0.0175
    smooth_least: int = 5


DEFAULTS = Params()

#: Flags of a reading in a log; the tens digit is the class.
RAW, CORRECTED, FILLED, TRUSTED, PINNED = 0, 11, 12, 21, 22
#: km/h in one m/s.
KMH_PER_MS = 3.6
