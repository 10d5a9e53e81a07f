"""Whole lists of values: lengths must fit."""

import pytest

from seriesmith.plans import chain


def repaired(spark):
    rows = [("a", 0, 2, 50, 50, 100.0), ("a", 3, 1, None, 60, 100.0), ("b", 0, 1, 70, 70, 100.0)]
    return spark.createDataFrame(rows, "run_id string, seg int, len int, raw int, final int, conf double")


def values(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, values array<double>")


def test_lists_replace_the_values_of_their_runs(spark):
    got = chain.finalize_values(repaired(spark), values(spark, ("a", [51.6, None]))).orderBy("run_id", "frame").collect()
    assert [(r["run_id"], r["frame"], r["speed"]) for r in got] == [("a", 0, 52), ("a", 1, 52), ("a", 2, -1), ("b", 0, 70)]
    assert chain.finalize_values(repaired(spark), values(spark)).count() == 4


@pytest.mark.parametrize("rows", [[("a", [1.0])], [("a", [1.0, 2.0, 3.0])], [("b", [])], [("c", [1.0])]])
def test_a_list_of_another_length_is_refused(spark, rows):
    with pytest.raises(Exception, match="not one for each segment"):
        chain.finalize_values(repaired(spark), values(spark, *rows)).collect()
