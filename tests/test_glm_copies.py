"""Cross-validated models over rows that repeat."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import glm


def test_equal_rows_are_fitted_as_one_and_count_as_all(spark, monkeypatch):
    cells = spark.range(1500).selectExpr("id % 2 as k", "cast(pmod(hash(id), 4) + id % 2 as double) y", "cast(id % 5 as double) x", "cast(pmod(hash(id, 1), 3) + 1 as int) fold")
    one = cells.withColumn("x", F.col("x") + F.rand(3) * 1e-9)  # no two rows are equal
    seen = []
    fit = glm.glm
    monkeypatch.setattr(glm, "glm", lambda df, *a, **kw: seen.append(df.count()) or fit(df, *a, **kw))
    got, plain = ({(r.k, r.fold): r for r in glm.cross_validate_glm(df, ["k"], "y", {"x": F.col("x")}, "poisson", folds=3).collect()} for df in (cells, one))
    assert len(got) == 6 and seen[0] < 300 and seen[1] == 3000
    for key, r in got.items():
        o = plain[key]
        assert (r.n_test, r.refitted) == (o.n_test, o.refitted)
        for c in ("rmse", "mae", "ss_res", "ss_tot", "r_squared", "deviance"):
            assert r[c] == pytest.approx(o[c], rel=1e-6)
