"""Kernels of five bands against dense algebra, and the plans that use them against plain counts."""

import numpy as np
import pytest

from driftloom.operators import banded, derivatives, windows
from driftloom.operators.panel import Panel


def dense(bands):
    return np.diag(bands[0]) + sum(np.diag(bands[k], k) + np.diag(bands[k], -k) for k in (1, 2) if len(bands[k]))


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_solve_and_inverse_bands(n):
    rng = np.random.default_rng(n)
    bands = (rng.uniform(5, 6, n), rng.uniform(-1, 1, max(n - 1, 0)), rng.uniform(-1, 1, max(n - 2, 0)))
    full, right = dense(bands), rng.normal(size=n)
    factors = banded.factor(bands)
    assert np.allclose(banded.solve(factors, right), np.linalg.solve(full, right))
    assert np.allclose(banded.times(bands, right), full @ right)
    inverse = np.linalg.inv(full)
    for k, band in enumerate(banded.inverse_bands(factors)):
        assert np.allclose(band, np.diag(inverse, k)[: len(band)])


@pytest.mark.parametrize("penalty", [1e-4, 0.1, 1.0, 100.0])
def test_total_variation_is_optimal(penalty):
    """No sum of squares and jumps is smaller than the one found: its subgradient holds zero."""
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.05, 0.3, 40))
    z = np.abs(t - 3) + 0.05 * rng.normal(size=40)
    u, _ = derivatives.tv_derivative(z, t, penalty)
    s = (z - z[0]).std(ddof=1)
    a = np.tril(np.tile(np.append(np.diff(t), 0.0), (40, 1)), -1)
    gradient = 2 * a.T @ (a @ (u / s) - (z - z[0]) / s)
    # D'w = -gradient for some |w| <= penalty / s, which is the sign of the jump where u jumps.
    w = np.cumsum(gradient)[:-1]
    jump, bound = np.diff(u), penalty / s
    assert np.abs(w).max() <= bound * (1 + 1e-4) + 1e-9
    clear = np.abs(jump) > 1e-4
    assert np.allclose(w[clear], bound * np.sign(jump[clear]), atol=1e-3 * bound)


def test_long_series_take_linear_time():
    import time

    t = np.linspace(0, 20, 20_000)
    z = np.sin(t) + 0.01 * np.random.default_rng(1).normal(size=len(t))
    began = time.perf_counter()
    d, _ = derivatives.tv_derivative(z, t, 0.1)
    smooth = derivatives.spline_derivative(t, z)
    assert time.perf_counter() - began < 60
    assert np.sqrt(np.mean((smooth - np.cos(t)) ** 2)) < 0.1 and np.sqrt(np.mean((d - np.cos(t)) ** 2)) < 0.2


def test_spline_matches_dense_smoother():
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.uniform(0.5, 1.5, 12))
    z = np.sin(t) + 0.1 * rng.normal(size=12)
    h = np.diff(t)
    q, r = np.zeros((12, 10)), np.zeros((10, 10))
    for j in range(10):
        q[j : j + 3, j] = [1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j < 9:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    k = q @ np.linalg.solve(r, q.T)
    best = None
    for penalty in np.logspace(-8, 4, 40) * np.trace(r) / np.trace(q.T @ q) * 12:
        hat = np.linalg.inv(np.eye(12) + penalty * k)
        score = 12 * ((z - hat @ z) ** 2).sum() / (12 - np.trace(hat)) ** 2
        if best is None or score < best[0]:
            best = (score, hat @ z)
    g = best[1]
    second = np.concatenate([[0], np.linalg.solve(r, q.T @ g), [0]])
    expected = np.diff(g) / h - h * (2 * second[:-1] + second[1:]) / 6
    assert np.allclose(derivatives.spline_derivative(t, z)[:-1], expected, atol=1e-6)


def test_order_balance_counts_all_pairs():
    v = np.random.default_rng(2).integers(0, 30, 500).astype(float)
    assert banded.order_balance(v) == sum(np.sign(v[j] - v[i]) for i in range(500) for j in range(i + 1, 500))


def test_change_points_match_rolling_variance(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=120)
    z[60:64] += 40
    df = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate(z)] + [(2, 0.0, 1.0)], "series_id int, t double, z double")
    variance = np.array([np.var(z[max(0, i - 12) : i + 13], ddof=1) for i in range(120)])
    limit = variance.mean() + 2 * variance.std(ddof=1)
    peaks = [i for i in range(1, 119) if variance[i] > limit and variance[i] > variance[i - 1] and variance[i] > variance[i + 1]]
    found = windows.change_points(df, Panel()).orderBy("t").collect()
    assert [(r.series_id, r.t) for r in found] == [(1, float(i)) for i in peaks] and len(peaks) > 0
    assert np.allclose([r.variance for r in found], variance[peaks])
