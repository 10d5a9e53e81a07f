"""Pictures as a recogniser takes them: the column operator against the array functions."""

import numpy as np
from pyspark.sql import functions as F

from seriesmith.operators import pixels


def test_prepared_and_scaled(spark):
    rng = np.random.default_rng(1)
    rows = [(k, h, w, rng.integers(0, 256, h * w).tolist()) for k, (h, w) in enumerate([(5, 9), (10, 4), (5, 9), (12, 3), (12, 30), (3, 50)])]
    rows += [(90, 0, 0, []), (91, None, 3, [1]), (92, 2, 2, None)]
    df = spark.createDataFrame(rows, "frame int, h int, w int, px array<int>")
    got = {r["frame"]: r for r in pixels.prepared(df, 12).withColumn("x", pixels.scaled(F.col("levels"), F.col("width"), F.lit(40))).collect()}
    for k, h, w, px in rows[:6]:
        image = np.floor(255.0 * (np.array(px).reshape(h, w) / 255.0) ** 2).astype(np.float32)
        wide = max(1, w * 12 // h)
        want = pixels.resize_bilinear(image, 12, wide)
        assert got[k]["width"] == wide and np.allclose(got[k]["levels"], want.ravel(), atol=1e-4)
        assert np.allclose(np.array(got[k]["x"]).reshape(1, 12, -1), pixels.recogniser_input(image, None, 12, 40), atol=1e-5)
    assert all(got[k]["width"] is None and got[k]["levels"] is None and got[k]["x"] is None for k in (90, 91, 92))
