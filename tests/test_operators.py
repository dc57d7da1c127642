"""Operators against known dynamics, direct computation and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import scalars, tails
from driftloom.functions.equations import Equation
from driftloom.operators import derivatives, dynamics, moments, regression, search, validation, windows
from driftloom.operators.panel import Panel, specify_variables
from driftloom.plans import explore
from driftloom.sources import tables

PANEL = Panel()


def series(spark, z, t=None, key=1):
    t = range(len(z)) if t is None else t
    return spark.createDataFrame([(key, float(a), float(b)) for a, b in zip(t, z)], "series_id long, t double, z double")


def values(df, column, order="t"):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


@pytest.mark.parametrize("method", ["savgol", "spline", "spectral"])
def test_derivative_of_sine(spark, method):
    t = np.arange(128) * (2 * np.pi / 128)
    got = np.array(values(derivatives.derivative(series(spark, np.sin(t), t), PANEL, method), "d_z"))
    assert np.abs(got - np.cos(t))[4:-4].max() < 0.02


def test_savgol_is_exact_for_cubics_also_at_ends(spark):
    t = np.arange(30.0)
    got = np.array(values(derivatives.savitzky_golay(series(spark, t**3, t), PANEL), "d_z"))
    assert np.allclose(got, 3 * t**2, atol=1e-6)


def test_finite_difference_with_uneven_steps(spark):
    got = values(derivatives.finite_difference(series(spark, [0, 1, 9], [0, 1, 3]), PANEL), "d_z")
    assert got == [1.0, 3.0, 4.0]


def test_total_variation_follows_a_kink():
    t = np.arange(60.0) / 10
    z = np.where(t < 3, t, 6 - t)
    d, _ = derivatives.tv_derivative(z, t, 1e-3)
    assert abs(np.median(d[5:25]) - 1) < 0.05 and abs(np.median(d[35:55]) + 1) < 0.05


def test_short_and_empty_series(spark):
    assert derivatives.finite_difference(series(spark, []), PANEL).count() == 0
    assert values(derivatives.finite_difference(series(spark, [3.0]), PANEL), "d_z") == [None]
    assert values(derivatives.savitzky_golay(series(spark, [3.0, 4.0]), PANEL), "d_z") == [None, None]


def test_rolling_median_at_even_ends(spark):
    assert values(windows.rolling_median(series(spark, [5, 1, 4, 2]), PANEL, 1), "median") == [3.0, 4.0, 2.0, 3.0]


def test_interpolation_outside(spark):
    left, right = series(spark, [0, 0, 0], [-1, 1.5, 9]).drop("z"), spark.createDataFrame([(1, 0.0, 10.0), (1, 3.0, 40.0)], "series_id long, t double, x double")
    assert values(windows.interpolate(left, right, PANEL, "x"), "x") == [10.0, 25.0, 40.0]
    assert values(windows.interpolate(left, right, PANEL, "x", clamp=False), "x") == [None, 25.0, None]


def test_ieee_scalars(spark):
    row = spark.range(1).select(scalars.ln(F.lit(0.0)), scalars.ln(F.lit(-1.0)), scalars.inverse(F.lit(0.0)), scalars.divide(F.lit(0.0), F.lit(0.0)), scalars.finite(F.lit(float("nan")))).first()
    assert row[0] == -math.inf and math.isnan(row[1]) and row[2] == math.inf and math.isnan(row[3]) and row[4] is None


@pytest.mark.parametrize("text", ["2 * x^2 - 3 / (x + 4)", "-x^2 + exp(-x)", "logistic(x) * relu(x - 1)", "threshold(x, 1) + square(x)"])
def test_equation_column_equals_numpy(spark, text):
    x = [0.5, 1.0, 2.5]
    got = values(series(spark, x).withColumn("x", F.col("z")).withColumn("y", Equation(text).column()), "y")
    assert np.allclose(got, Equation(text).values({"x": np.array(x)}))


def test_equation_forms():
    e = Equation("2.5 * x^2 - sin(y)")
    assert e.names() == ["x", "y"] and e.parameterised(["x", "y"]).coefficients == {"c1": 2.5}
    assert e.latex() == r"2.5 \cdot {x}^{2} - \sin\left(y\right)"
    with pytest.raises(ValueError):
        Equation("__import__('os')").column()


def test_tails():
    assert abs(tails.chi2(3.841459, 1) - 0.05) < 1e-6
    assert abs(tails.f_tail(4.1709, 1, 30) - 0.05) < 1e-4
    assert abs(tails.normal_two_sided(1.959964) - 0.05) < 1e-6


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - 3 * x[:, 1] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "k int, a double, b double, y double")
    row = regression.least_squares(df, ["k"], F.col("y"), {"a": F.col("a"), "b": F.col("b")}).first()
    design = np.column_stack([np.ones(200), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert np.allclose([row["(Intercept)"], row["a"], row["b"]], beta) and np.isclose(row["rss"], rss[0])


def test_dependent_terms_have_no_coefficients(spark):
    df = spark.createDataFrame([(1, float(i), 2.0 * i) for i in range(9)], "k int, a double, y double")
    assert regression.least_squares(df, ["k"], F.col("y"), {"a": F.col("a"), "b": 2 * F.col("a")}).first()["a"] is None


def test_nonlinear_fit_finds_constants(spark):
    x = np.linspace(-3, 3, 60)
    df = spark.createDataFrame([(float(a), float(3.7 * a**2 + 5)) for a in x], "x double, y double")
    fit = regression.fit_equation(df, Equation("a * x^2 + b"), "y")
    assert abs(fit.coefficients["a"] - 3.7) < 1e-6 and abs(fit.coefficients["b"] - 5) < 1e-6


def test_fixed_points_of_logistic_and_of_none(spark):
    rows = dynamics.analyse_fixed_points(spark, Equation("2 * z - z^2"), "z", -5, 5, 100).collect()
    assert [round(r.fixed_point, 9) for r in rows] == [0.0, 2.0] and [r.stability for r in rows] == ["unstable", "stable"]
    assert dynamics.analyse_fixed_points(spark, Equation("z^2 + 1"), "z").count() == 0


@pytest.mark.parametrize("method,error", [("euler", 0.05), ("rk4", 1e-6)])
def test_simulation_of_decay(spark, method, error):
    last = dynamics.simulate(spark, Equation("-z"), "z", 1.0, 0.05, 40, method=method).orderBy(F.desc("step")).first()
    assert abs(last.value - math.exp(-2)) < error


def test_stochastic_simulation_is_repeatable(spark):
    run = lambda: dynamics.simulate(spark, Equation("-z"), "z", 1.0, 0.1, 20, Equation("0.3"), 50).orderBy("sim", "step").collect()
    assert run() == run()


def test_folds_partition_every_row(spark):
    df = series(spark, range(50))
    for f in (validation.block_folds(df, PANEL, 3), validation.random_folds(df, PANEL, 3)):
        sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
        assert sum(sizes) == 50 and len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    roles = validation.rolling_folds(df, PANEL, 3, 2).filter("role = 'test'").select("rn").collect()
    assert sorted(r.rn for r in roles) == [45, 46, 47, 48, 49, 50]


def test_selection_prefers_the_earliest_among_equals(spark):
    scores = spark.createDataFrame([(1, float("inf")), (2, 0.5), (3, 0.5), (4, float("nan"))], "iteration int, score double")
    assert validation.select_iteration(scores).first().iteration == 2


def test_pareto_front_and_knee(spark):
    c = spark.createDataFrame([(3, 0.5, "a"), (5, 0.3, "b"), (6, 0.4, "x"), (8, 0.25, "c"), (12, 0.24, "d")], "complexity int, mse double, equation string")
    assert [r.equation for r in search.pareto_front(c).orderBy("complexity").collect()] == ["a", "b", "c", "d"]
    assert search.knee(search.pareto_front(c)).first().equation == "b"


def test_csv_with_null_tokens_and_dates(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,v,w\n2024-01-01,1.5,a\n2024-01-02,NA,b\n")
    df = tables.with_numeric_time(tables.read_csv(spark, str(tmp_path / "x.csv")))
    assert [(r.time, r.v, r.w) for r in df.collect()] == [(19723.0, 1.5, "a"), (19724.0, None, "b")]


def test_examples_follow_their_dynamics(spark):
    assert all(tables.load_example(spark, n).count() > 20 for n in tables.EXAMPLES)
    with pytest.raises(ValueError, match="logistic_growth"):
        tables.load_example(spark, "none")


def test_roles_name_missing_columns(spark):
    with pytest.raises(ValueError, match="absent"):
        specify_variables(series(spark, [1]), endogenous=("absent",))


def test_phase_finds_the_parabola(spark):
    z = np.linspace(0.1, 3, 80)
    df = spark.createDataFrame([(1, float(a), float(2 * a - a * a + 0.01 * math.sin(37 * a))) for a in z], "k int, z double, d_z double")
    assert explore.phase(df, ["k"], "d_z", "z").first().form in ("quadratic", "cubic")


def test_moments_of_constant_series(spark):
    row = moments.describe(series(spark, [2.0] * 12), PANEL).first()
    assert row.sd == 0 and row.skewness is None and row.kurtosis is None


def test_reports_and_exports(spark, tmp_path):
    from driftloom.sources import writers

    df = spark.createDataFrame([("a|b", 1.5, None), ("c", float("nan"), 2)], "name string, x double, n int")
    assert writers.markdown(df).splitlines()[2] == r"| a\|b | 1.5000 |  |" and "NA" in writers.latex(df)
    assert all(title in writers.report({"One": df}, form=f) for f, title in (("markdown", "## One"), ("html", "<h2>One</h2>"), ("latex", "section{One}")))
    assert [r.json for r in writers.to_json(df).orderBy("name").collect()] == ['{"name":"a|b","x":1.5,"n":null}', '{"name":"c","x":null,"n":2}']
    paths = writers.export({"t": df}, str(tmp_path), ("parquet", "csv", "json"))
    assert len(paths) == 3 and spark.read.parquet(paths[0]).count() == 2


def test_stochastic_model_recovers_a_linear_drift(spark):
    from driftloom.plans import models

    rng = np.random.default_rng(4)
    z = [1.0]
    for _ in range(400):
        z.append(z[-1] + 0.05 * (2 - z[-1]) + 0.02 * rng.normal())
    df = derivatives.finite_difference(series(spark, z), PANEL)
    drift = models.stochastic_model(df, PANEL, "d_z", ["z"]).drift.first()
    assert abs(drift["z"] + 0.05) < 0.02 and abs(drift["(Intercept)"] - 0.1) < 0.04


def test_genetic_search_gives_finite_candidates(spark):
    df = spark.createDataFrame([(float(x), float(2 * x + 1)) for x in np.linspace(-2, 2, 40)], "x double, y double")
    front = search.pareto_front(search.genetic(df, "y", ["x"], runs=2, population=20, generations=6)).collect()
    assert front and all(math.isfinite(r.mse) for r in front) and front == sorted(front, key=lambda r: r.complexity)
