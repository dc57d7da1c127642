"""Least squares far from zero, fits within bounds, and generalised linear models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions.equations import Equation
from driftloom.operators import bounded, glm, regression, search
from driftloom.plans import explore


def test_a_line_over_epoch_days_by_the_minute(spark):
    df = spark.range(180).select(F.lit(1).alias("k"), (19700 + F.col("id") / 1440).alias("t")).withColumn("y", 2 + 3 * (F.col("t") - 19700))
    row = regression.least_squares(df, ["k"], F.col("y"), {"t": F.col("t")}).first()
    assert row["t"] == pytest.approx(3, rel=1e-6) and row["(Intercept)"] == pytest.approx(2 - 3 * 19700, rel=1e-6)


@pytest.mark.parametrize("weighted", [False, True])
def test_residuals_beside_a_large_offset(spark, weighted):
    rng = np.random.default_rng(1)
    x = np.arange(2000.0)
    y = 1e7 + 3 * x + rng.normal(0, 0.1, 2000)
    w = 1 + x % 3 if weighted else np.ones(2000)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y, "w": w}))
    row = regression.least_squares(df, ["k"], F.col("y"), {"x": F.col("x")}, F.col("w") if weighted else None).first()
    design = np.c_[np.ones(2000), x] * np.sqrt(w)[:, None]
    beta, rss, *_ = np.linalg.lstsq(design, (y - 1e7) * np.sqrt(w), rcond=None)
    assert row.rss == pytest.approx(rss[0], rel=1e-5) and row["x"] == pytest.approx(beta[1], rel=1e-9)


def test_exhaustive_tells_forms_apart_beside_a_large_offset(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(1, 5, 3000), rng.uniform(1, 5, 3000)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": 1e8 + 2 * a * a + rng.normal(0, 0.1, 3000)}))
    found = search.exhaustive(df, "y", ["a", "b"]).toPandas().set_index("form").mse
    assert found["square(a)"] == pytest.approx(0.01, rel=0.1) and found.drop("square(a)").min() > 0.05


def test_phase_of_a_parabola_far_from_the_origin(spark):
    t = np.arange(19700.0, 19760.0)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "z": t, "d_z": (t - 19730) ** 2}))
    row = explore.phase(df, ["k"], "d_z", "z").first()
    assert row.form == "quadratic" and (row.low, row.high) == (19700, 19759) and row.aic_cubic is not None
    assert row.coefficients_quadratic == pytest.approx([19730.0**2, -2 * 19730, 1], rel=1e-6)


def test_phase_publishes_all_forms_as_polyfit_does(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(-2, 3, 500)
    y = 1 - 2 * z + 0.5 * z**3 + rng.normal(0, 0.2, 500)
    row = explore.phase(spark.createDataFrame(pd.DataFrame({"k": 1, "z": z, "d_z": y})), ["k"], "d_z", "z").first()
    assert row.form == "cubic"
    for degree, form in enumerate(explore.FORMS, 1):
        want = np.polyfit(z, y, degree)
        rss = ((np.polyval(want, z) - y) ** 2).sum()
        assert row[f"coefficients_{form}"] == pytest.approx(want[::-1], rel=1e-8)
        assert row[f"aic_{form}"] == pytest.approx(500 * np.log(2 * np.pi * rss / 500) + 500 + 2 * (degree + 2), rel=1e-9)


def test_phase_of_a_constant_has_no_form(spark):
    df = spark.createDataFrame([(1, 2.0, float(i)) for i in range(9)], "k int, z double, d_z double")
    row = explore.phase(df, ["k"], "d_z", "z").first()
    assert row.form is None and row.slope is None


def frame(spark, n=60, seed=404):
    rng = np.random.default_rng(seed)
    x = np.linspace(-3, 3, n)
    return pd.DataFrame({"k": 1, "x": x, "y": 3.7 * x**2 + 5 + rng.normal(0, 0.5, n)})


def test_bounds_that_bind_and_ones_that_do_not(spark):
    p = frame(spark)
    df = spark.createDataFrame(pd.concat([p, p.assign(k=2, y=p.y / 2)]))
    fit = bounded.fit_bounded(df, ["k"], Equation("a * x^2 + b"), "y", {"a": 1.0, "b": 1.0}, upper={"a": 3.0})
    rows = {r.k: r for r in fit.collect()}
    free = np.polyfit(p.x**2, p.y / 2, 1)
    assert rows[1].a == 3.0 and rows[1].b == pytest.approx((p.y - 3 * p.x**2).mean(), rel=1e-8) and rows[1].at_bound == ["a"]
    assert (rows[2].a, rows[2].b) == (pytest.approx(free[0], rel=1e-7), pytest.approx(free[1], rel=1e-7)) and rows[2].at_bound == []
    assert all(r.converged and r.method == "steps" and r.n == 60 for r in rows.values())


def test_weights_are_honoured(spark):
    p = frame(spark)
    p["w"] = np.where(p.x < 0, 100.0, 1.0)
    row = bounded.fit_bounded(spark.createDataFrame(p), ["k"], Equation("a * x^2 + b"), "y", {"a": 1.0, "b": 1.0}, weight="w").first()
    want = np.polyfit(p.x**2, p.y, 1, w=np.sqrt(p.w))
    assert (row.a, row.b) == (pytest.approx(want[0], rel=1e-7), pytest.approx(want[1], rel=1e-7))
    plain = bounded.fit_bounded(spark.createDataFrame(p), [], Equation("a * x^2 + b"), "y", {"a": 1.0, "b": 1.0}).first()
    assert abs(plain.a - row.a) > 1e-4


def test_a_start_without_a_finite_loss_falls_back_to_the_grid(spark):
    x = np.linspace(0, 10, 80)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * np.sqrt(x + 0.5)}))
    row = bounded.fit_bounded(df, [], Equation("a * (x + b) ^ 0.5"), "y", {"a": 1.0, "b": -5.0}).first()
    assert row.method == "grid" and row.a == pytest.approx(2, rel=1e-6) and row.b == pytest.approx(0.5, rel=1e-5)


def test_steps_that_do_not_settle_fall_back_to_the_simplex(spark):
    x = np.linspace(0, 1, 50)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 3 * x + 1}))
    row = bounded.fit_bounded(df, [], Equation("a * x + b"), "y", {"a": 5.0, "b": 4.0}, lower={"a": 0.0}, upper={"a": 2.0}, rounds=1).first()
    assert row.method == "simplex" and row.converged and row.a == pytest.approx(2, abs=1e-5) and row.b == pytest.approx(1.5, abs=1e-4)


def test_nothing_finite_gives_nulls_and_crossed_bounds_an_error(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(5)], "x double, y double")
    row = bounded.fit_bounded(df, [], Equation("a / (x - x)"), "y", {"a": 1.0}).first()
    assert row.a is None and row.rss is None and not row.converged
    with pytest.raises(ValueError):
        bounded.fit_bounded(df, [], Equation("a * x"), "y", {"a": 1.0}, lower={"a": 2.0}, upper={"a": 1.0})


def irls(x, y, w, family):
    """A plain dense solution by Newton steps of the log-likelihood's score."""
    design = np.c_[np.ones(len(y)), x]
    link, back, slope, var = {
        "poisson": (np.log, np.exp, np.exp, lambda m: m),
        "binomial": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-e) / (1 + np.exp(-e)) ** 2, lambda m: m * (1 - m)),
        "gamma": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / e**2, lambda m: m * m),
        "gaussian": (lambda m: m, lambda e: e, lambda e: np.ones(len(e)), lambda m: np.ones(len(m))),
    }[family]
    eta = link({"poisson": y + 0.1, "binomial": (y + 0.5) / 2}.get(family, y))
    for _ in range(60):
        mu, s = back(eta), slope(eta)
        h = w * s**2 / var(mu)
        beta = np.linalg.solve(design.T @ (design * h[:, None]), design.T @ (h * (eta + (y - mu) / s)))
        eta = design @ beta
    cov = np.linalg.inv(design.T @ (design * h[:, None]))
    chi = (w * (y - back(eta)) ** 2 / var(back(eta))).sum() / (len(y) - design.shape[1])
    return beta, np.sqrt(np.diag(cov) * (chi if family in ("gamma", "gaussian") else 1))


@pytest.mark.parametrize("family", ["gaussian", "poisson", "binomial", "gamma"])
def test_models_equal_a_dense_solution(spark, family):
    rng = np.random.default_rng(5)
    parts, want = [], {}
    for k in (1, 2):
        x = np.c_[rng.normal(100 * k, 1, 400), rng.uniform(0, 1, 400)]
        eta = 0.5 + 0.3 * (x[:, 0] - 100 * k) + 0.4 * x[:, 1]
        y = {"gaussian": eta + rng.normal(0, 1, 400), "poisson": rng.poisson(np.exp(eta)).astype(float), "binomial": (rng.uniform(size=400) < 1 / (1 + np.exp(-eta))).astype(float), "gamma": rng.gamma(5, 1 / (5 * np.maximum(eta + 2, 0.3)))}[family]
        w = rng.uniform(0.5, 2, 400)
        parts.append(pd.DataFrame({"k": k, "a": x[:, 0], "b": x[:, 1], "y": y, "w": w}))
        want[k] = irls(x, y, w, family)
    terms = {"a": F.col("a"), "b": F.col("b")}
    fit = glm.glm(spark.createDataFrame(pd.concat(parts)), ["k"], "y", terms, family, weight=F.col("w"))
    for r in fit.collect():
        assert r.converged and r.n == 400
        assert [r["(Intercept)"], r.a, r.b] == pytest.approx(want[r.k][0], rel=1e-8)
        assert [r["se_(Intercept)"], r.se_a, r.se_b] == pytest.approx(want[r.k][1], rel=1e-6)


def test_poisson_cross_validation_is_on_the_response_scale(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 300)
    p = pd.DataFrame({"k": 1, "x": x, "y": rng.poisson(np.exp(1 + 0.5 * x)).astype(float), "fold": np.arange(300) % 3 + 1})
    got = {r.fold: r for r in glm.cross_validate_glm(spark.createDataFrame(p), ["k"], "y", {"x": F.col("x")}, "poisson", folds=3).collect()}
    for f in (1, 2, 3):
        train, test = p[p.fold != f], p[p.fold == f]
        beta, _ = irls(train[["x"]].to_numpy(), train.y.to_numpy(), np.ones(len(train)), "poisson")
        e = test.y - np.exp(beta[0] + beta[1] * test.x)
        assert got[f].rmse == pytest.approx(np.sqrt((e**2).mean()), rel=1e-8) and got[f].refitted
        assert got[f].ss_tot == pytest.approx(((test.y - train.y.mean()) ** 2).sum(), rel=1e-9)


def test_models_without_a_solution(spark):
    df = spark.createDataFrame([(1, float(i), 2.0 * i, -1.0) for i in range(20)], "k int, a double, b double, y double")
    assert not glm.glm(df, ["k"], "y", {"a": F.col("a"), "b": F.col("b")}).first().converged  # dependent
    row = glm.glm(df, ["k"], "y", {"a": F.col("a")}, "poisson").first()  # impossible target
    assert not row.converged and row.a is None
