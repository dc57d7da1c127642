"""Coupled simulation: closed forms, invariants, strong order, and ties of the noise."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions.equations import Equation
from driftloom.functions.errors import NameCollision, UndeclaredName
from driftloom.operators.systems import simulate_system

PREY = {"x": Equation("a * x - b * x * y"), "y": Equation("d * b * x * y - c * y")}


def species(spark):
    return spark.createDataFrame([(1, 2.0, 1.0, 1.0, 0.5, 0.8, 0.9), (2, 1.0, 2.0, 0.7, 0.4, 0.5, 1.1)], "k int, x double, y double, a double, b double, c double, d double")


def test_predator_and_prey_keep_their_invariant(spark):
    got = simulate_system(species(spark), ["k"], PREY, 0.02, 1000, method="rk4").toPandas()
    assert len(got) == 2 * 1001
    for r in species(spark).toPandas().itertuples():
        x, y = (got[got.k == r.k].sort_values("step")[v].to_numpy() for v in "xy")
        kept = r.d * r.b * x - r.c * np.log(x) + r.b * y - r.a * np.log(y)
        assert np.ptp(kept) < 1e-6 and np.ptp(x) > 0.4


def test_euler_equals_a_plain_loop(spark):
    got = simulate_system(species(spark), ["k"], PREY, 0.05, 200).toPandas()
    for r in species(spark).toPandas().itertuples():
        x, y = r.x, r.y
        for _ in range(200):
            x, y = x + 0.05 * (r.a * x - r.b * x * y), y + 0.05 * (r.d * r.b * x * y - r.c * y)
        last = got[(got.k == r.k) & (got.step == 200)].iloc[0]
        assert (last.x, last.y, last.t) == pytest.approx((x, y, 10.0), rel=1e-10)


def test_noise_does_not_depend_on_partitions_and_reruns_agree(spark):
    def paths(n):
        s = simulate_system(species(spark).repartition(n), ["k"], PREY, 0.05, 20, {"x": {"w": Equation("0.1 * x")}}, sims=30)
        return s.orderBy("k", "sim", "step").toPandas()

    one = paths(1)
    pd.testing.assert_frame_equal(one, paths(4))
    assert one[one.step == 20].x.nunique() == 60


def test_sources_are_shared_and_correlated(spark):
    start = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "k int, x double, y double, z double")
    still = {v: Equation("0 * x") for v in "xyz"}
    noise = {"x": {"u": Equation("1 + 0 * x")}, "y": {"u": Equation("2 + 0 * x")}, "z": {"v": Equation("1 + 0 * x")}}
    end = simulate_system(start, ["k"], still, 0.25, 16, noise, {("u", "v"): -0.6}, sims=6000).filter("step = 16").toPandas()
    assert end.y.to_numpy() == pytest.approx(2 * end.x.to_numpy(), abs=1e-12)
    assert (end.x.mean(), end.x.var(), end.x.corr(end.z)) == (pytest.approx(0, abs=0.11), pytest.approx(4, rel=0.08), pytest.approx(-0.6, abs=0.04))


def test_strong_order_of_a_half(spark):
    """Geometric noise: errors at the end against the exact solution on the same Brownian path fall with the root of the step."""
    start = spark.createDataFrame([(1, 1.0, 0.0)], "k int, x double, w double")
    drift = {"x": Equation("0.5 * x"), "w": Equation("0 * x")}
    noise = {"x": {"u": Equation("0.8 * x")}, "w": {"u": Equation("1 + 0 * x")}}
    error = []
    for size in (1, 4, 16):
        end = simulate_system(start, ["k"], drift, size / 256, 256 // size, noise, sims=2000, increments=size).filter(F.col("step") == 256 // size).toPandas()
        error.append(np.abs(end.x - np.exp(0.5 - 0.32 + 0.8 * end.w)).mean())
    assert np.log(error[2] / error[0]) / np.log(16) == pytest.approx(0.5, abs=0.12)


def test_values_that_leave_the_numbers_and_nulls(spark):
    start = spark.createDataFrame([(1, 1e200, 1.0), (2, None, 1.0), (3, 1.0, None), (4, 1.0, 0.5)], "k int, x double, a double")
    got = simulate_system(start, ["k"], {"x": Equation("a * x * x")}, 1.0, 3)
    assert got.count() == 16
    nulls = {r.k: r.n for r in got.groupBy("k").agg(F.count_if(F.col("x").isNull()).alias("n")).collect()}
    assert nulls == {1: 3, 2: 4, 3: 4, 4: 0}
    assert simulate_system(start.limit(0), ["k"], {"x": Equation("a * x")}, 1.0, 3).count() == 0


def test_names_are_accounted_for(spark):
    with pytest.raises(UndeclaredName):
        simulate_system(species(spark), ["k"], {"x": Equation("q * x")}, 0.1, 2)
    with pytest.raises(UndeclaredName):
        simulate_system(species(spark), ["k"], {"x": Equation("a * x")}, 0.1, 2, {"y": {"u": Equation("a * x")}})
    with pytest.raises(NameCollision):
        simulate_system(species(spark).withColumn("t", F.lit(1.0)), ["k"], {"t": Equation("a * t")}, 0.1, 2)
    with pytest.raises(np.linalg.LinAlgError):
        simulate_system(species(spark), ["k"], PREY, 0.1, 2, {"x": {"u": Equation("a * x")}, "y": {"v": Equation("a * x")}}, {("u", "v"): 2.0})


def test_ends_alone_are_those_of_whole_paths(spark):
    noise = {"x": {"w": Equation("0.1 * x")}}
    whole = simulate_system(species(spark), ["k"], PREY, 0.05, 20, noise, sims=7).filter("step >= 19")
    ends = simulate_system(species(spark), ["k"], PREY, 0.05, 20, noise, sims=7, first=19)
    assert sorted(ends.collect()) == sorted(whole.collect()) and ends.count() == 2 * 7 * 2


def test_starts_are_dealt_to_many_tasks(spark):
    start = spark.range(400).groupBy(F.col("id").alias("k")).agg(F.lit(1.0).alias("x"))
    ends = simulate_system(start, ["k"], {"x": Equation("-x")}, 0.1, 5, first=5)
    assert ends.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
