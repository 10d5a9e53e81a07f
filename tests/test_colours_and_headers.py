"""Colour planes of packed pictures, header keys and their options, truth files and their stand-ins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import text
from seriesmith.operators import pixels
from seriesmith.sources import logs


@pytest.mark.parametrize("height, width", [(4, 6), (5, 7), (1, 1), (5, 8)])
def test_columns_give_the_colours_of_the_arrays(spark, height, width):
    rng = np.random.default_rng(height * width)
    rows = height + (height + 1) // 2
    while rows * 2 // 3 != height:
        rows += 1
    packed = rng.integers(0, 256, (rows, width), dtype=np.uint8)
    want = pixels.nv12_to_rgb(packed, height, width)
    df = spark.createDataFrame([(packed.ravel().tolist(), rows, width)], "px array<int>, rows int, width int")
    got = df.select(pixels.nv12_planes(F.col("px"), F.col("rows"), F.col("width")).alias("c")).select("c.*").first()
    assert [got[n] for n in ("red", "green", "blue")] == [want[:, :, k].ravel().tolist() for k in range(3)]


def test_colours_of_known_points():
    def one(y, u, v):
        return pixels.nv12_to_rgb(np.array([[y, y], [y, y], [u, v]], np.uint8), 2, 2)[0, 0].tolist()

    assert one(16, 128, 128) == [0, 0, 0] and one(255, 128, 128) == [255, 255, 255]
    assert one(81, 90, 240) == [254, 0, 0]  # red


def test_header_keys_and_options(spark):
    line = "log 2 fps=29.97, roi=1,2,3,4,div=3,buffer = 5, buffer=7,codec=h264, empty=,model=big"
    df = spark.createDataFrame([(line,)], "text string")
    got = df.select(text.header_map(F.col("text")).alias("settings"))
    assert got.first()[0] == {"fps": "29.97", "roi": "1,2,3,4", "div": "3,buffer = 5", "buffer": "7", "codec": "h264", "empty": "", "model": "big"}
    typed = logs.typed_settings(got).first()
    assert (typed["set_div"], typed["set_buffer"], typed["set_codec"]) == (None, 7, "h264")
    keys = spark.createDataFrame([("model",), ("fps",), ("other",)], "k string")
    assert [r[0] for r in keys.select(text.destination(F.col("k"))).collect()] == ["ocr_model", "fps", None]


def test_reference_files_stand_in_for_truth(spark, tmp_path):
    for name, speed in (("a_truth", 1), ("a_ref", 2), ("b_ref", 3), ("c_other", 4)):
        (tmp_path / f"{name}.csv").write_text(f"# fps=30\n0,0.0,{speed}\nbad\n7,1.5,{speed}0\n")
    got = sorted(tuple(r) for r in logs.read_truths(spark, f"file://{tmp_path}").collect())
    assert got == [("a", 0, 1.0), ("a", 7, 10.0), ("b", 0, 3.0), ("b", 7, 30.0)]
