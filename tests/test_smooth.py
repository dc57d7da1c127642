"""Additive smooth fits against dense solves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import regression, smooth
from driftloom.operators.panel import Panel


def design(x, low, step, pieces):
    """Cubic B-splines at x by the recursion over their degree."""
    knots = low + step * np.arange(-3, pieces + 4)
    at = np.minimum(x, knots[-4] - 1e-12 * step)[:, None]
    b = ((knots[:-1] <= at) & (at < knots[1:])).astype(float)
    for d in (1, 2, 3):
        left = (at - knots[: -d - 1]) / (d * step) * b[:, :-1]
        b = left + (knots[d + 1 :] - at) / (d * step) * b[:, 1:]
    return b


def dense(y, w, xs, row, penalties, pieces):
    blocks = [design(x, row.lows[i], row.steps[i], pieces) for i, x in enumerate(xs)]
    turn = np.diff(np.eye(pieces + 3), 2, axis=0)
    a = np.hstack([np.ones((len(y), 1)), *blocks])
    s = np.zeros((a.shape[1],) * 2)
    for i, e in enumerate(penalties):
        at = slice(1 + i * (pieces + 3), 1 + (i + 1) * (pieces + 3))
        s[at, at] = e * turn.T @ turn
    gram = (a * w[:, None]).T @ a
    inverse = np.linalg.pinv(gram + s, rcond=1e-11, hermitian=True)
    fitted = a @ inverse @ (a.T @ (w * y))
    edf, rss = np.trace(inverse @ gram), (w * (y - fitted) ** 2).sum()
    return fitted, edf, rss, len(y) * rss / (len(y) - edf) ** 2


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_a_smooth_equals_the_dense_solve(spark, offset):
    rng = np.random.default_rng(5)
    x = rng.uniform(19700, 19710, 400)
    y = offset + np.sin(x) + rng.normal(0, 0.2, 400)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "id": range(400), "x": x, "y": y}))
    fits = smooth.additive(df, ["k"], F.col("y"), ["x"]).cache()
    row = fits.first()
    got = smooth.predict_additive(df, fits, ["k"], ["x"]).toPandas().sort_values("id").prediction
    fitted, edf, rss, gcv = dense(y - offset, np.ones(400), [x], row, row.penalties, 10)
    assert got.to_numpy() - offset == pytest.approx(fitted, abs=1e-6)
    assert (row.edf, row.rss, row.gcv) == pytest.approx((edf, rss, gcv), rel=1e-6) and row.n == 400
    others = [dense(y - offset, np.ones(400), [x], row, [row.penalties[0] * e], 10)[3] for e in np.logspace(-3, 3, 61)]
    assert row.gcv <= min(others) * (1 + 1e-4)


def test_two_smooths_with_weights_and_two_keys(spark):
    rng = np.random.default_rng(6)
    n = 600
    d = pd.DataFrame({"k": np.arange(n) % 2, "id": range(n), "a": rng.uniform(-2, 2, n), "b": rng.normal(0, 3, n), "w": rng.integers(1, 4, n).astype(float)})
    d["y"] = d.a**3 * (1 + d.k) + np.cos(d.b) + rng.normal(0, 0.3, n)
    fits = smooth.additive(spark.createDataFrame(d), ["k"], F.col("y"), ["a", "b"], F.col("w"), pieces=6).cache()
    got = smooth.predict_additive(spark.createDataFrame(d), fits, ["k"], ["a", "b"]).toPandas().sort_values("id")
    for row in fits.collect():
        s, mine = d[d.k == row.k], got[got.k == row.k]
        fitted, edf, rss, gcv = dense(s.y.to_numpy(), s.w.to_numpy(), [s.a.to_numpy(), s.b.to_numpy()], row, row.penalties, 6)
        assert mine.prediction.to_numpy() == pytest.approx(fitted, abs=1e-6)
        assert (row.edf, row.rss, row.gcv) == pytest.approx((edf, rss, gcv), rel=1e-5)


def test_lines_go_on_beyond_the_range_and_without_keys(spark):
    x = np.arange(50.0)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 3 - 2 * x}))
    fits = smooth.additive(df, [], F.col("y"), ["x"])
    far = spark.createDataFrame([(-20.0,), (25.5,), (80.0,), (None,)], "x double")
    got = [r.prediction for r in smooth.predict_additive(far, fits, [], ["x"]).orderBy(F.col("x").asc_nulls_last()).collect()]
    assert got[:3] == pytest.approx([43.0, -48.0, -157.0], rel=1e-6) and got[3] is None


def test_edges_of_an_additive_fit(spark):
    rows = [("flat", 1.0, float(i)) for i in range(5)] + [("two", 0.0, 1.0), ("two", 1.0, 3.0)] + [("none", None, 1.0), ("none", float("nan"), 1.0)] + [("one", 2.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    fits = smooth.additive(df, ["k"], F.col("y"), ["x"])
    got = {r.k: r for r in fits.collect()}
    assert set(got) == {"flat", "two", "one"} and got["flat"].edf == 1 and got["flat"].intercept == pytest.approx(2.0)
    assert got["one"].intercept == pytest.approx(7.0) and got["two"].gcv is None and got["two"].rss == pytest.approx(0, abs=1e-9)
    assert smooth.additive(df.limit(0), ["k"], F.col("y"), ["x"]).count() == 0
    with pytest.raises(ValueError):
        smooth.additive(df, ["k"], F.col("y"), [])


def test_diffusion_that_follows_the_state(spark):
    rng = np.random.default_rng(7)
    z = [5.0]
    for _ in range(3000):
        z.append(z[-1] + 0.1 * (5 - z[-1]) * 0.1 + 0.4 * abs(z[-1]) * np.sqrt(0.1) * rng.normal())
    df = spark.createDataFrame(pd.DataFrame({"series_id": 1, "t": 0.1 * np.arange(3001), "z": z}))
    line = regression.diffusion_model(df, Panel(), ["z"]).first()
    curve = regression.diffusion_model(df, Panel(), ["z"], "gam").first()
    assert line["z"] > 0.15 and curve.rss <= line.rss * (1 + 1e-6) and curve.edf >= 2
    with pytest.raises(ValueError):
        regression.diffusion_model(df, Panel(), ["z"], "cubic")
