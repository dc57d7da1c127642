"""Names, draws and typed errors of fixed points, and simulation at uneven times."""

import numpy as np
import pytest

from driftloom.functions import errors
from driftloom.functions.equations import Equation
from driftloom.operators import dynamics


def test_every_name_is_accounted_for(spark):
    e = Equation("a * z + x", {"a": -1.0})
    with pytest.raises(errors.UndeclaredName):
        dynamics.analyse_fixed_points(spark, e, "z")
    with pytest.raises(errors.NameCollision):
        dynamics.analyse_fixed_points(spark, e, "z", exogenous={"z": 1.0, "x": 1.0})
    with pytest.raises(errors.NameCollision):
        dynamics.analyse_fixed_points(spark, e, "z", exogenous={"a": 1.0, "x": 1.0})
    with pytest.raises(errors.UnknownName):
        dynamics.analyse_fixed_points(spark, e, "z", exogenous={"x": 1.0}, coefficients={"b": 1.0})
    with pytest.raises(errors.UnknownName):
        dynamics.analyse_bifurcations(spark, e, "z", "q", -1.0, 1.0)
    with pytest.warns(UserWarning):
        row = dynamics.analyse_fixed_points(spark, e, "z", exogenous={"x": 3.0, "y": 1.0}, coefficients={"a": -2.0}).first()
    assert abs(row.fixed_point - 1.5) < 1e-9 and row.stability == "stable"


def test_draws_are_thinned_evenly_and_keep_their_points(spark):
    draws = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "draw long, a double")
    kept = [r.draw for r in dynamics.thin_draws(draws, 7).orderBy("draw").collect()]
    assert kept == sorted({round(float(x)) for x in np.linspace(1, 100, 7)})
    found = dynamics.analyse_fixed_points(spark, Equation("a - z"), "z", 0.0, 200.0, 50, draws=draws, n_draws=7).orderBy("draw").collect()
    assert [r.draw for r in found] == kept and np.allclose([r.fixed_point for r in found], kept)
    with pytest.raises(errors.SubstitutionIgnored):
        dynamics.analyse_fixed_points(spark, Equation("1 - z"), "z", draws=draws)
    with pytest.raises(errors.UnknownName):
        dynamics.thin_draws(draws.filter("draw > 1"), 5)


def test_status_tells_no_root_from_no_value(spark):
    _, status = dynamics.analyse_bifurcations(spark, Equation("r / (r * r + z * z) + log(r)"), "z", "r", -1.0, 1.0, 3, 1.0, 2.0, 10)
    assert [(round(x.r), x.status) for x in status.orderBy("r").collect()] == [(-1, "unevaluable"), (0, "unevaluable"), (1, "none")]


def test_consensus_counts_draws_without_points(spark):
    points = spark.createDataFrame([(1.0, 1, 0.5, "stable"), (2.0, 1, 0.1, "stable"), (2.0, 2, 0.3, "unstable"), (2.0, 3, 0.2, "stable")], "u double, draw int, fixed_point double, stability string")
    rows = dynamics.consensus(points, 3, keys=["u"]).collect()
    assert [(r.u, r.branch, r.fixed_point, r.stability) for r in rows] == [(2.0, 1, 0.2, "stable")]


@pytest.mark.parametrize("method", ["euler", "milstein", "rk4"])
def test_paths_at_uneven_times(spark, method):
    times = list(np.cumsum([0.0, *np.random.default_rng(1).uniform(0.005, 0.02, 200)]))
    inputs = spark.createDataFrame([(0.0, 1.0), (10.0, 1.0)], "t double, x double")
    rows = dynamics.simulate_at(spark, Equation("x - z"), "z", 0.0, times, Equation("0.1"), 300, method, inputs).toPandas()
    last = rows[rows.step == 200].value
    exact = 1 - np.exp(-times[-1])
    assert len(rows) == 300 * 201 and abs(last.mean() - exact) < 0.03 and 0.04 < last.std() < 0.1
    again = dynamics.simulate_at(spark, Equation("x - z"), "z", 0.0, times, Equation("0.1"), 300, method, inputs.repartition(3)).toPandas()
    assert np.array_equal(rows.sort_values(["sim", "step"]).value, again.sort_values(["sim", "step"]).value)


def test_a_path_that_explodes_is_null_from_there(spark):
    rows = dynamics.simulate_at(spark, Equation("z^2"), "z", 10.0, [0.0, 1.0, 2.0, 3.0, 9.0, 99.0, 999.0, 9999.0, 99999.0, 999999.0]).orderBy("step").toPandas().value
    assert rows.notna().iloc[0] and rows.isna().iloc[-1] and rows.isna().is_monotonic_increasing
    with pytest.raises(errors.UndeclaredName):
        dynamics.simulate_at(spark, Equation("x - z"), "z", 0.0, [0.0, 1.0])
