"""Refits by fold run inside tasks, on rows that go there once."""

import numpy as np
import pytest

from driftloom.functions.equations import Equation
from driftloom.operators import refit
from driftloom.operators.panel import Panel

LINE = Equation("a + b * x", {"a": 0.0, "b": 0.0})


def odd_rows(spark, n=40):
    """Series of 1, 2 and ``n`` rows, some with nulls in target, variable or weight, and one without a key."""
    rng, rows = np.random.default_rng(7), []
    for key, m in (("one", 1), ("two", 2), ("whole", n), ("holes", n), (None, n)):
        for i in range(m):
            x = float(rng.uniform(0, 4))
            hole = {3: "y", 11: "x", 17: "w"}.get(i) if key == "holes" else None
            got = {"x": x, "y": 2 * x + float(rng.normal()), "w": float(i + 1)}
            rows.append((key, float(i), *[None if c == hole else got[c] for c in "xyw"], i % 4 + 1))
    return spark.createDataFrame(rows, "series_id string, t double, x double, y double, w double, fold int")


def scores(spark, df, equation=LINE):
    return refit.cross_validate_folds(df, ["series_id"], equation, "y", "w", folds=4).toPandas().sort_values(["series_id", "fold"]).reset_index(drop=True)


def test_a_blocked_score_takes_few_jobs_and_no_copies_of_rows(spark):
    df = spark.range(900).selectExpr("id % 9 series_id", "cast(id as double) t", "cast(id % 7 as double) x", "sin(id) z", "1.0D + id w")
    context = spark.sparkContext
    context.setJobGroup("blocked score", "")
    scored = refit.blocked_score(df, Panel(), LINE, "z", "w")
    assert scored.count() == 9
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("blocked score")) <= 8
    assert "explode" not in scored._jdf.queryExecution().toString()


def test_scores_of_rows_with_nulls_against_numpy(spark):
    df = odd_rows(spark)
    got = scores(spark, df).set_index(["series_id", "fold"])
    assert set(got.index.get_level_values(0)) == {"two", "whole", "holes"}  # one row trains nothing, no key no series
    assert not got.refitted["two"].any() and got.refitted["whole"].all() and got.refitted["holes"].all()
    rows = df.toPandas()
    for key in ("whole", "holes"):
        of = rows[rows.series_id == key]
        for f in range(1, 5):
            train, test, r = of[of.fold != f].dropna(), of[of.fold == f], got.loc[(key, f)]
            b, a = np.polyfit(train.x, train.y, 1, w=np.sqrt(train.w))
            e = test.y - a - b * test.x
            assert np.isclose(r.rmse, np.sqrt((e**2).mean()), rtol=1e-6) and np.isclose(r.deviance, (test.w * e**2).sum() / test.w.sum(), rtol=1e-6)
            assert np.isclose(r.mass, test.w.sum()) and r.n_test == test.y.count() and r.n_train == of[of.fold != f].y.count()


def test_long_groups_have_the_same_scores(spark, monkeypatch):
    df = odd_rows(spark)
    near = scores(spark, df)
    for most in (0, 5):  # all, or some of the groups by rounds over the rows
        monkeypatch.setattr(refit, "MOST_LOCAL", most)
        far = scores(spark, df)[near.columns]
        assert far[["series_id", "fold", "n_train", "n_test", "refitted"]].equals(near[["series_id", "fold", "n_train", "n_test", "refitted"]])
        for c in ("rmse", "mae", "ss_res", "ss_tot", "deviance", "mass", "r_squared"):
            assert np.allclose(far[c], near[c], rtol=1e-6, equal_nan=True)


@pytest.mark.parametrize("most", [0, 20_000])
def test_infinite_and_missing_numbers_are_told_from_each_other(spark, monkeypatch, most):
    monkeypatch.setattr(refit, "MOST_LOCAL", most)
    df = spark.range(40).selectExpr("id % 2 series_id", "cast(id as double) x", "CASE WHEN id = 8 THEN double('nan') WHEN id = 9 THEN null ELSE 3.0D * id + 1 END y")
    fits = {r.series_id: r for r in refit.fit_groups(df, ["series_id"], LINE, "y", {"a": 0.0, "b": 0.0}).collect()}
    assert not fits[0].converged and fits[0].rss is None and fits[0].b == 0 and fits[0].n == 20
    assert fits[1].converged and np.isclose(fits[1].b, 3) and np.isclose(fits[1].a, 1) and fits[1].n == 19


def test_keys_may_be_times_of_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(40).selectExpr("timestamp_seconds(id % 2 * 86400) AS day", "cast(id as double) x", "2.0D * id y")
        fits = refit.fit_groups(df, ["day"], LINE, "y", {"a": 0.0, "b": 0.0})
        assert fits.join(df.select("day").distinct(), "day").filter("converged and abs(b - 2) < 1e-6").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
