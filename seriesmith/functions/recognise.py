"""A recogniser as a column function: pictures in, text and score out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

RESULT = "text string, score double"


def recogniser(load: Callable[[], Callable[[list], list[tuple[str | None, float]]]], batch: int = 16):
    """An iterator function over a column of pictures; ``load`` runs once per task and gives the engine.

    The engine takes ``batch`` pictures at a time and gives a text and a score for each; a null
    picture gives nulls. Reduce to one picture per segment first: no rule moves it below a grouping.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = load()
        for pictures in batches:
            out: list[tuple] = [(None, None)] * len(pictures)
            there = [k for k, p in enumerate(pictures) if p is not None]
            for a in range(0, len(there), batch):
                part = there[a : a + batch]
                for k, found in zip(part, engine([pictures.iloc[k] for k in part])):
                    out[k] = found
            yield pd.DataFrame(out, columns=["text", "score"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT)
