"""Smoothing splines with asked degrees of freedom, against a dense smoother."""

import numpy as np
import pandas as pd
import pytest

from driftloom.operators import derivatives


def dense(t, penalty):
    """The smoother matrix of the natural cubic spline: (I + penalty K)^-1 with K = Q R^-1 Q'."""
    h, n = np.diff(t), len(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j - 1, j] = r[j, j - 1] = h[j] / 6
    return np.linalg.inv(np.eye(n) + penalty * q @ np.linalg.solve(r, q.T))


@pytest.mark.parametrize("freedom", [2.5, 5, 12.3, 35])
def test_asked_and_reached_freedom_agree(freedom):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 10, 40))
    s = derivatives.Spline(t, np.sin(t) + rng.normal(0, 0.1, 40))
    penalty = s.penalty_of(freedom)
    smoother = dense(t, penalty)
    assert np.trace(smoother) == pytest.approx(freedom, abs=1e-3)
    assert s.at(penalty)[1] == pytest.approx(smoother @ s.z, abs=1e-6)


def test_freedom_out_of_range_is_held(spark):
    t = np.arange(30.0)
    df = spark.createDataFrame(pd.DataFrame({"series_id": 1, "t": t, "z": t**2}))
    stiff = derivatives.smoothing_spline(df, freedom=0.0).toPandas().sort_values("t").d_z
    loose = derivatives.smoothing_spline(df, freedom=99.0).toPandas().sort_values("t").d_z
    assert np.ptp(stiff) < 1 and stiff.mean() == pytest.approx(29, abs=0.5)
    assert loose.iloc[5:25].to_numpy() == pytest.approx(2 * t[5:25], abs=0.05)
