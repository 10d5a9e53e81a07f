"""Statistics of pictures against plain evaluators."""

import random
from statistics import median

import numpy as np

from seriesmith.operators import pixels


def plain_otsu(px):
    best, at = -1.0, 127
    for t in sorted(set(px))[:-1]:
        low, high = [x for x in px if x <= t], [x for x in px if x > t]
        apart = len(low) * len(high) * (np.mean(low) - np.mean(high)) ** 2
        if apart > best + 1e-6:
            best, at = apart, t
    return at


def test_calibration_takes_thresholds_and_not_means(spark):
    rng = random.Random(4)
    rows = [(label, k, [rng.choice([10, 20, 30, 40, 200 + label]) for _ in range(64)]) for label in (1, 2) for k in range(60)]
    rows.append((3, 0, [9] * 64))
    got = {r["label"]: r["threshold"] for r in pixels.calibration(spark.createDataFrame(rows, "label int, vec_id int, px array<int>"), "label", "vec_id").collect()}
    want = {label: int(median(plain_otsu(px) for a, k, px in rows if a == label and k < 50)) for label in (1, 2, 3)}
    means = {label: int(median(np.mean(px) for a, k, px in rows if a == label and k < 50)) for label in (1, 2, 3)}
    assert got == want and got[3] == 127 and got[1] != means[1]


def test_every_pixel_has_an_output(spark, monkeypatch):
    from seriesmith.queries import pictures

    px = [random.Random(5).randint(0, 255) for _ in range(64)]
    monkeypatch.setattr(pictures, "_pictures", lambda spark, sf_dir: spark.createDataFrame([(1, 0, px)], "vec_id int, label int, px array<int>"))
    row = pictures.whole_gray_and_gamma(spark, "").collect()[0]
    gamma = [int(255 * (x / 255) ** 2) for x in px]
    assert row["gamma"] == " ".join(map(str, gamma))
    assert row["full_range"] == " ".join(str(min(max(int(np.floor((x - 16) * 255 / 219 + 0.5)), 0), 255)) for x in px)
    assert row["gray"] == " ".join(str(int(px[k] * 0.299 + px[63 - k] * 0.587 + gamma[k] * 0.114)) for k in range(64))
