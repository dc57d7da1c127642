"""Bins, quantile pairs, front tables and scores against plain Python."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions.equations import Equation
from driftloom.operators import figures, search


def test_bins_are_round_and_hold_every_value(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"k": ["n"] * 200 + ["big"] * 50, "v": np.r_[rng.normal(size=200), 1e6 * rng.uniform(size=50)]})
    got = figures.histogram(spark.createDataFrame(d), ["k"], "v").toPandas().sort_values(["k", "bin"])
    for k, b in got.groupby("k"):
        v = d.v[d.k == k]
        edges = np.r_[b.low.to_numpy(), b.high.iloc[-1]]
        assert b["count"].tolist() == np.histogram(v, edges)[0].tolist() and b["count"].sum() == len(v)
        assert (b.density * (b.high - b.low)).sum() == pytest.approx(1) and b.bin.tolist() == list(range(1, len(b) + 1))
    assert (got[got.k == "n"].high - got[got.k == "n"].low).to_numpy() == pytest.approx(0.5)


def test_bins_of_edges_one_value_and_nothing(spark):
    df = spark.createDataFrame([("e", 0.0), ("e", 1.0), ("e", 2.0), ("e", 4.0), ("one", 3.0), ("one", 3.0), ("none", None), ("e", float("nan"))], "k string, v double")
    got = {(r.k, r.bin): (r.low, r.high, r["count"]) for r in figures.histogram(df, ["k"], "v").collect()}
    assert sum(c for (k, _), (_, _, c) in got.items() if k == "e") == 4 and got["e", 1][2] == 2
    assert [v[2] for (k, _), v in got.items() if k == "one"] == [2] and not any(k == "none" for k, _ in got)
    assert figures.histogram(df.limit(0), ["k"], "v").count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_pairs_and_line_equal_sorted_values(spark, keys):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"k": 1, "id": range(501), "v": np.r_[rng.normal(size=301), np.zeros(200)]})
    pairs = figures.normal_pairs(spark.createDataFrame(d), keys, "v", "id").cache()
    got = pairs.toPandas().sort_values("rank")
    want = d.sort_values(["v", "id"])
    assert got.id.tolist() == want.id.tolist() and got["rank"].tolist() == list(range(1, 502))
    assert got.theoretical.to_numpy() == pytest.approx([NormalDist().inv_cdf((i + 0.5) / 501) for i in range(501)])
    line, (low, high) = figures.normal_line(pairs, keys).first(), np.quantile(d.v, [0.25, 0.75])
    z = NormalDist().inv_cdf(0.75)
    assert (line.slope, line.intercept) == pytest.approx(((high - low) / (2 * z), (high + low) / 2))


def test_front_table_flags_one_row(spark):
    results = spark.createDataFrame([(1, 4.0, "a"), (2, 1.0, "b"), (2, 3.0, "c"), (3, 0.9, "d"), (4, float("inf"), "e")], "complexity int, mse double, equation string")
    got = figures.front_table(search.pareto_front(results), results).toPandas().set_index("equation")
    assert set(got.index) == {"a", "b", "c", "d"} and got.is_selected[got.is_selected].index.tolist() == ["b"]
    assert not got.on_front["c"] and got.rmse["b"] == 1


def test_match_back_within_a_tolerance(spark):
    front = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 1e12)], "complexity int, mse double")
    full = spark.createDataFrame([(1, 0.5 + 6e-11, "b"), (1, 0.5 - 6e-11, "a"), (1, 0.5 + 2e-10, "0"), (2, 0.2500001, "c"), (3, 1e12, "d"), (2, 0.5, "x")], "complexity int, mse double, equation string")
    got = {r.complexity: r.record for r in search.match_back(front, full).collect()}
    assert got[1].equation == "a" and got[2] is None and got[3].equation == "d" and len(got) == 3


def test_scores_of_a_front(spark):
    x = np.linspace(0.1, 3, 40)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + 1})).unionByName(spark.createDataFrame([(None, 5.0)], "x double, y double"))
    got = search.front_scores(df, "y", [Equation("2 * x + 1"), Equation("100.5"), Equation("log(x - 1)"), Equation("x")]).toPandas().set_index("equation")
    assert list(got.complexity) == sorted(got.complexity) and "log(x - 1)" not in got.index
    assert got.r_squared["2 * x + 1"] == 1 and got.r_squared["100.5"] == -1 and got.n_constants["2 * x + 1"] == 2
    assert got.mae["x"] == pytest.approx(np.mean(x + 1)) and got.structure["100.5"] == "C"
    assert search.front_scores(df.filter(F.lit(False)), "y", [Equation("x")]).count() == 0
    flat = search.front_scores(df.withColumn("y", F.lit(3.0)), "y", [Equation("x")]).first()
    assert flat.r_squared == 0
