"""The reweighted search for drifts against a plain numpy loop over one series at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions.equations import Equation
from driftloom.operators.panel import Panel
from driftloom.plans.stochastic import fit_stochastic

PANEL = Panel(keys=("k",))
FORMS = [(1, "z", lambda z: z), (2, "inv(z)", lambda z: 1 / z), (2, "square(z)", lambda z: z * z), (2, "log(abs(z) + 1e-10)", lambda z: np.log(abs(z) + 1e-10))]


def weighted_line(x, y, w):
    design = np.c_[np.ones(len(x)), x] * np.sqrt(w)[:, None]
    return np.linalg.lstsq(design, y * np.sqrt(w), rcond=None)[0]


def plain(z, y, most, tol, selection="blocked_cv", blocks=5):
    """One series: (form, beta, history of deviances, converged, selected iteration, score)."""
    n = len(z)

    def search(w):
        scored = []
        for complexity, name, f in FORMS:
            b = weighted_line(f(z), y, w)
            mse = (w * (y - b[0] - b[1] * f(z)) ** 2).sum() / w.sum()
            scored.append((n * np.log(mse) + complexity * np.log(n), complexity, name, f, b))
        return min(scored, key=lambda s: s[:2])[2:]

    name, f, b = search(np.ones(n))
    fit, tried, converged = b[0] + b[1] * f(z), [], False
    for i in range(most):
        g = weighted_line(z, abs(y - fit), np.ones(n))
        w = 1 / np.maximum(np.maximum(g[0] + g[1] * z, 0) ** 2, 1e-10)
        name, f, b = search(w)
        new = b[0] + b[1] * f(z)
        dev = (w * (y - new) ** 2).sum() / w.sum()
        tried.append((name, f, b, dev))
        if i:
            objective = abs(dev - tried[-2][3]) / (abs(tried[-2][3]) + 1e-12)
            iterate = np.sqrt((w * (new - fit) ** 2).sum() / w.sum()) / (np.sqrt((w * fit**2).sum() / w.sum()) + 1e-12)
            converged = objective < tol and iterate < tol
        fit = new
        if converged:
            break
    rn = np.arange(1, n + 1)
    block = np.minimum(blocks, (rn * blocks - 1) // n + 1)
    scores = []
    for _, f, b, _ in tried:
        total = 0.0
        for j in range(1, blocks + 1):
            test = block == j
            c = weighted_line(f(z)[~test], y[~test], w[~test]) if selection == "blocked_cv" else b
            total += (w[test] * (y[test] - c[0] - c[1] * f(z)[test]) ** 2).sum()
        scores.append(total / w.sum())
    chosen = int(np.argmin(scores))
    return tried[chosen][0], tried[chosen][2], [t[3] for t in tried], converged, chosen + 1, scores[chosen]


def sample(seed=0, n=150):
    """Series with drifts of several forms and noise that grows with z; rows are shuffled."""
    rng, out = np.random.default_rng(seed), []
    for k, f in enumerate((lambda z: 1 - 2 * z, lambda z: 3 / z, lambda z: 0.4 * z * z - 1, lambda z: 2 * np.log(z), lambda z: 0 * z + 1), 1):
        z = rng.uniform(0.5, 4, n)
        out.append(pd.DataFrame({"k": k, "t": np.arange(n) * 0.5, "z": z, "d_z": f(z) + rng.normal(0, 1, n) * (0.1 + 0.2 * z)}))
    return pd.concat(out).sample(frac=1, random_state=1)


@pytest.mark.parametrize("selection", ["blocked_cv", "deviance"])
def test_equals_a_plain_loop(spark, selection):
    data = sample()
    m = fit_stochastic(spark.createDataFrame(data), PANEL, "d_z", ["z"], criterion="BIC", max_iterations=4, tolerance=1e-3, selection=selection)
    drift = m.drift.toPandas().set_index("k")
    history = m.history.toPandas().sort_values(["k", "iteration"])
    assert len(drift) == 5
    for k, rows in data.groupby("k"):
        rows = rows.sort_values("t")
        form, beta, deviances, converged, selected, score = plain(rows.z.to_numpy(), rows.d_z.to_numpy(), 4, 1e-3, selection)
        got = drift.loc[k]
        numbers = np.array(got.beta)
        assert (got.form, bool(got.converged), got.n_iterations, got.rule) == (form, converged, len(deviances), selection)
        assert numbers[0] == pytest.approx(beta[0], rel=1e-7) and numbers[numbers != 0][-1] == pytest.approx(beta[1], rel=1e-7)
        assert history[history.k == k].deviance.tolist() == pytest.approx(deviances, rel=1e-7)
        assert got.score == pytest.approx(score, rel=1e-7) and got.selected_iteration == selected
    assert drift.converged.any() and set(drift.stop_reason) <= {"converged", "max_iter"}
    assert drift.loc[drift.converged, "converged_at"].tolist() == drift.loc[drift.converged, "n_iterations"].tolist()


def test_forms_and_diffusion_are_recovered(spark):
    m = fit_stochastic(spark.createDataFrame(sample(3, 2000)), PANEL, "d_z", ["z"], criterion="BIC", diffusion="residual", tolerance=1e-3)
    drift = m.drift.toPandas().set_index("k")
    assert drift.form.loc[[1, 2, 3, 4]].tolist() == ["z", "inv(z)", "square(z)", "log(abs(z) + 1e-10)"]
    assert np.array(drift.beta[3])[[0, 3]] == pytest.approx([-1, 0.4], abs=0.05)
    for g in m.diffusion.toPandas().g:  # of a normal error the absolute size is sqrt(2 / pi) of its deviation; the intercept's standard error is 0.016
        assert np.array(g) == pytest.approx(np.array([0.1, 0.2]) * np.sqrt(2 / np.pi), abs=0.065)


def test_predicts_both_components(spark):
    df = spark.createDataFrame(sample())
    m = fit_stochastic(df, PANEL, "d_z", ["z"], max_iterations=2)
    d = m.predict(df)
    assert d.columns == [*df.columns, "drift", "diffusion"] and d.count() == df.count()
    assert m.predict(df, "drift").columns == [*df.columns, "drift"] and m.predict(df, "diffusion").columns == [*df.columns, "diffusion"]
    row = d.filter("k = 1").first()
    beta = m.drift.filter("k = 1").first()
    assert Equation(beta.equation).values({"z": np.array([row.z])})[0] == pytest.approx(row.drift, rel=1e-7)
    assert row.diffusion >= 0
    with pytest.raises(ValueError):
        m.predict(df, "noise")


def test_an_initial_drift_starts_the_first_weights(spark):
    data = sample()
    df = spark.createDataFrame(data)
    line = ({"z": F.col("z")}, [(1, ["z"])])
    m = fit_stochastic(df, PANEL, "d_z", ["z"], library=line, initial=Equation("1 - 2 * z"), max_iterations=1)
    rows = data[data.k == 1]
    z, y = rows.z.to_numpy(), rows.d_z.to_numpy()
    g = weighted_line(z, abs(y - 1 + 2 * z), np.ones(len(z)))
    beta = weighted_line(z, y, 1 / np.maximum((g[0] + g[1] * z) ** 2, 1e-10))
    got = m.drift.filter("k = 1").first()
    assert got.beta == pytest.approx(beta, rel=1e-8) and (got.stop_reason, got.n_iterations) == ("max_iter", 1)


def test_a_knee_over_two_predictors(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(1, 3, 800), rng.uniform(1, 3, 800)
    data = pd.DataFrame({"k": 1, "t": np.arange(800.0), "a": a, "b": b, "z": a, "d_z": 1 + 2 * a - b + 3 * a * b + rng.normal(0, 0.1, 800)})
    m = fit_stochastic(spark.createDataFrame(data), PANEL, "d_z", ["a", "b"], criterion="min_error", max_iterations=3)
    got = m.drift.first()
    assert got.form == "a + b + a * b" and got.complexity == 3
    assert [v for v in got.beta if v] == pytest.approx([1, 2, -1, 3], abs=0.15)


def test_edges(spark):
    schema = "k string, t double, z double, d_z double, g double, n string"
    rows = [("null", float(i), None, 1.0, 0.0, "x") for i in range(5)]
    rows += [("flat", float(i), 2.0, float(i), 0.0, None) for i in range(6)] + [("short", 0.0, 1.0, 4.0, 0.0, "x")]
    rows += [("exact", float(i), float(i), 3.0 + 2 * i, 0.0, "x") for i in range(40)] + [("exact", 99.0, 1.0, float("nan"), 0.0, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r.k: r for r in fit_stochastic(df, PANEL, "d_z", ["z"], max_iterations=3).drift.collect()}
    assert set(got) == {"flat", "short", "exact"}  # no row is left of the first
    assert (got["flat"].form, got["flat"].beta[0]) == ("1", 2.5) and (got["short"].form, got["short"].beta[0]) == ("1", 4.0)
    assert got["exact"].form == "z" and got["exact"].beta[:2] == pytest.approx([3, 2], rel=1e-6) and got["exact"].n == 40
    assert got["short"].rule == "deviance_fallback"
    empty = fit_stochastic(df.limit(0), PANEL, "d_z", ["z"], max_iterations=2)
    assert empty.drift.count() == empty.diffusion.count() == empty.history.count() == 0
    with pytest.raises(ValueError):
        fit_stochastic(df, PANEL, "d_z", ["z"], selection="luck")
    # A predictor may have the name of a column of the state.
    named = fit_stochastic(df.withColumn("g", F.col("z")), PANEL, "d_z", ["g"], max_iterations=2).drift.filter("k = 'exact'").first()
    assert named.form == "g"
