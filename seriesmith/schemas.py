"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T

SERIES = T.StructType.fromDDL("run_id long, seg int, mid int, len int, raw int")
LOG = T.StructType.fromDDL("run_id long, frame int, dist_m double, speed_kmh int, flag int")
TRUTH = T.StructType.fromDDL("run_id long, frame int, truth double")
EDITS = T.StructType.fromDDL("run_id long, seg int, value double")
RUNS = T.StructType.fromDDL("run_id long, path string, fps double, width int, height int, codec string, frame_count int, duration_s double")
FRAMES = T.StructType.fromDDL("run_id long, frame int, h int, w int, px array<int>")
SAMPLES = T.StructType.fromDDL("t double, rss_mb double, cpu_pct double, util_pct double, vram_mb double, gpu_temp_c double")
