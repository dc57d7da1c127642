"""Bounded fits inside tasks: few jobs, and the same as in rounds over all rows."""

import numpy as np
import pandas as pd
import pytest

from driftloom.functions.equations import Equation
from driftloom.operators import bounded


def panel(spark, groups=12):
    rng = np.random.default_rng(11)
    parts = []
    for k in range(groups):
        x = np.linspace(0, 1, 20 + k)
        parts.append(pd.DataFrame({"k": k, "s": f"g{k % 3}", "x": x, "y": (1 + k) * np.exp(-x * (k - 5) / 4) + rng.normal(0, 0.05, len(x)), "w": rng.uniform(0.5, 2, len(x))}))
    df = pd.concat(parts).reset_index(drop=True)
    df.loc[[3, 30], "y"] = None
    return spark.createDataFrame(df).selectExpr("k", "s", "x", "nullif(y, double('nan')) y", "w")


def test_fits_in_tasks_equal_fits_in_rounds(spark, monkeypatch):
    df, got = panel(spark), []
    for most in (20_000, 25):  # all groups in tasks, or the shorter ones
        monkeypatch.setattr(bounded, "MOST_LOCAL", most)
        rows = bounded.fit_bounded(df, ["k", "s"], Equation("a * exp(b * x)"), "y", {"a": 1.0, "b": 0.0}, upper={"b": 0.6}, weight="w").collect()
        got.append(sorted(rows))
    assert len(got[0]) == len(got[1]) == 12
    for r, o in zip(*got, strict=True):
        assert (r.k, r.s, r.n, r.converged, r.method, r.at_bound) == (o.k, o.s, o.n, o.converged, o.method, o.at_bound)
        assert (r.a, r.b, r.rss) == pytest.approx((o.a, o.b, o.rss), rel=1e-4)


def test_many_groups_take_few_jobs(spark, monkeypatch):
    written = []
    settled = bounded.settled
    monkeypatch.setattr(bounded, "settled", lambda df: written.append(1) or settled(df))
    fit = bounded.fit_bounded(panel(spark), ["k"], Equation("a * exp(b * x)"), "y", {"a": 1.0, "b": 1e5})
    assert fit.filter("converged and method = 'grid'").count() == 12
    assert len(written) <= 6
