"""Refits of an equation per group and fold, and residual tests, against numpy."""

import numpy as np
import pandas as pd
import pytest

from driftloom.functions.equations import Equation
from driftloom.operators import moments, refit, search, validation
from driftloom.operators.panel import Panel
from driftloom.plans import explore, models


def frame(spark, n=90, keys=("a", "b"), seed=3):
    rng, rows = np.random.default_rng(seed), []
    for k, key in enumerate(keys):
        x = rng.uniform(0.5, 4, n)
        rows += [(key, float(i), float(v), float((2 + k) * np.exp(-0.7 * v) + 0.5 + 0.01 * rng.normal())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t double, x double, y double")


def test_groups_are_fitted_together(spark):
    fits = refit.fit_groups(frame(spark), ["series_id"], Equation("p * exp(q * x) + s"), "y", {"p": 1.0, "q": -0.5, "s": 0.1}).toPandas().set_index("series_id").sort_index()
    assert fits.converged.all() and np.allclose(fits.p, [2, 3], atol=0.05) and np.allclose(fits.q, -0.7, atol=0.05) and (fits.n == 90).all()


def test_a_fit_that_is_never_finite_is_not_converged(spark):
    fits = refit.fit_groups(frame(spark), ["series_id"], Equation("p / (x - x)"), "y", {"p": 1.0}).toPandas()
    assert len(fits) == 2 and not fits.converged.any() and (fits.p == 1.0).all()


@pytest.mark.parametrize("method", ["block", "random"])
def test_weighted_refits_of_a_line_against_numpy(spark, method):
    df = frame(spark).withColumnRenamed("t", "time").selectExpr("series_id", "time", "x", "y", "x * x AS w")
    p = Panel(time="time", value="y")
    folds = (validation.block_folds if method == "block" else validation.random_folds)(df, p, 4)
    got = refit.cross_validate_equation(refit.with_roles(folds, 4), ["series_id"], Equation("1.0 * x + 0.3"), "y", "w").toPandas()
    rows = folds.toPandas()
    for r in got.itertuples():
        of = rows[rows.series_id == r.series_id]
        train, test = of[of.fold != r.fold], of[of.fold == r.fold]
        b, a = np.polyfit(train.x, train.y, 1, w=np.sqrt(train.w))
        gap = test.y - a - b * test.x
        assert r.refitted and r.n_train == len(train) and r.n_test == len(test)
        assert np.isclose(r.rmse, np.sqrt((gap**2).mean()), rtol=1e-6) and np.isclose(r.deviance, np.average(gap**2, weights=test.w), rtol=1e-6)
        mean = np.average(train.y, weights=train.w)
        assert np.isclose(r.r_squared, 1 - (gap**2).sum() / ((test.y - mean) ** 2).sum(), rtol=1e-6)


def test_rolling_folds_refit_on_what_came_before(spark):
    df = frame(spark, keys=("a",))
    roles = validation.rolling_folds(df, Panel(value="y"), k=3, horizon=5)
    got = refit.cross_validate_equation(roles, ["series_id"], Equation("p * exp(q * x) + s", {"p": 1.0, "q": -0.5, "s": 0.0}), "y").toPandas().sort_values("fold")
    assert got.n_train.tolist() == [75, 80, 85] and (got.n_test == 5).all() and (got.rmse < 0.05).all()


def test_a_failed_refit_scores_the_equation_as_it_stands(spark):
    df = frame(spark, keys=("a",)).withColumnRenamed("t", "time").limit(4)
    folds = validation.block_folds(df, Panel(time="time", value="y"), 2)
    got = refit.cross_validate_equation(refit.with_roles(folds, 2), ["series_id"], Equation("2.0 * exp(-0.7 * x) + 0.5"), "y").toPandas()
    assert not got.refitted.any() and (got.rmse < 0.1).all()  # two rows cannot fit three numbers


def test_validate_model_validates_the_equation_it_is_given(spark):
    got = models.validate_model(frame(spark), Panel(value="y"), Equation("p * exp(q * x) + s", {"p": 2.0, "q": -0.7, "s": 0.5}), "y")
    assert (got["cross_validation"].toPandas().r_squared_pooled > 0.99).all() and got["folds"].count() == 10


def test_arch_uses_as_many_lags_as_rows_allow(spark):
    rng = np.random.default_rng(1)
    series = {n: rng.normal(size=n) * (1 + 0.5 * np.sin(np.arange(n))) for n in (15, 25, 38, 80)}
    df = spark.createDataFrame([(n, float(i), float(v)) for n, x in series.items() for i, v in enumerate(x)], "series_id long, t double, z double")
    got = {r.series_id: r for r in moments.arch(df).collect()}
    assert set(got) == {25, 38, 80}
    for n, r in got.items():
        lags, s = min(5, n // 10), series[n] ** 2
        x = np.column_stack([np.ones(n - lags), *[s[lags - i : n - i] for i in range(1, lags + 1)]])
        y = s[lags:]
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert r.df == lags and np.isclose(r.statistic, n * (1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()), rtol=1e-8)


def test_breusch_pagan_of_several_predictors_and_issues(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=200), rng.normal(size=200)
    e = rng.normal(size=200) * np.exp(a)
    df = spark.createDataFrame(pd.DataFrame({"series_id": 1, "t": np.arange(200.0), "z": e, "a": a, "b": b}))
    x = np.column_stack([np.ones(200), a, b])
    u = (e - x @ np.linalg.lstsq(x, e, rcond=None)[0]) ** 2
    left = u - x @ np.linalg.lstsq(x, u, rcond=None)[0]
    got = moments.breusch_pagan(df, Panel(), "z", ["a", "b"]).first()
    assert got.df == 2 and np.isclose(got.statistic, 200 * (1 - (left**2).sum() / ((u - u.mean()) ** 2).sum()), rtol=1e-8)
    tests = moments.diagnostics(df, Panel(), ["a", "b"])
    assert "Breusch-Pagan" in moments.issues(tests, ["series_id"]).first().issues


def test_fronts_are_apart_for_each_key(spark):
    df = spark.createDataFrame([("u", 1, 5.0, "a"), ("u", 2, 6.0, "b"), ("v", 1, 9.0, "c"), ("v", 2, 6.0, "d")], "k string, complexity int, mse double, equation string")
    assert sorted(r.equation for r in search.pareto_front(df, ["k"]).collect()) == ["a", "c", "d"]


def test_exhaustive_search_scans_once(spark):
    assert search.exhaustive(frame(spark), "y", ["x", "t"]).count() == 9  # 1 / t is not finite where t is 0
    df = frame(spark).selectExpr("y", "x", "t + 1 AS t")
    found = search.exhaustive(df, "y", ["x", "t"]).toPandas()
    assert len(found) == 10 and np.isfinite(found.mse).all()
    d = df.toPandas()
    x = np.column_stack([np.ones(len(d)), d.x, d.t, d.x * d.t])
    e = d.y - x @ np.linalg.lstsq(x, d.y, rcond=None)[0]
    assert np.isclose(found[found.form == "x + t + x * t"].mse.iloc[0], (e**2).mean())


def test_formulas_are_split_outside_of_calls():
    assert explore.summands("sin(a + b) + 1e+3 * a + -b") == ["sin(a + b)", "1e+3 * a", "-b"]
