"""Errors of candidates over many tasks."""

import numpy as np
import pytest

from driftloom.operators import search


def test_a_candidate_undefined_in_one_task_is_not_scored_on_the_others(spark):
    df = spark.range(40).selectExpr("cast(id as double) x", "cast(2 * id as double) y").repartition(8)
    got = search.errors(df, "y", ["(x * x) / x", "x + x", "x", "(x * x) / x + x"])
    assert got[0] == got[3] == np.inf and got[1] == 0.0
    assert got[2] == pytest.approx(np.mean(np.arange(40.0) ** 2))


def test_a_search_does_not_depend_on_partitions(spark):
    df = spark.range(60).selectExpr("id / 7 as x", "sin(id) + id / 3 as y")
    found = [search.genetic(df.repartition(n), "y", ["x"], runs=1, population=12, generations=3) for n in (1, 9)]
    assert sorted(found[0].collect()) == sorted(found[1].collect())
