"""Bootstrap of series by blocks: blocks across chunks, and no table of drawn rows in a broadcast."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import validation
from driftloom.operators.panel import Panel


def plain(df, spark, block, replicates):
    """Fits of the same draws, row by row."""
    out = {}
    for key, part in df.sort_values("t").groupby("series_id"):
        n = len(part)
        b = block or max(1, int(np.sqrt(n)))
        x, z = part.x.to_numpy(), part.z.to_numpy()
        ks = [(int(key), r, k, n, b) for r in range(1, replicates + 1) for k in range(-(-n // b))]
        hashed = spark.createDataFrame(ks, "series_id long, replicate int, k int, n long, b int")
        hashed = hashed.select("replicate", "k", F.pmod(F.xxhash64("series_id", "replicate", "k", F.lit(42)), F.col("n") - F.col("b") + 1).alias("s")).toPandas().sort_values(["replicate", "k"])
        for r, draws in hashed.groupby("replicate"):
            at = np.concatenate([np.arange(s, s + b) for s in draws.s])[:n]
            if len(set(x[at])) > 1:
                out[key, r] = np.polyfit(x[at], z[at], 1)
    return out


@pytest.mark.parametrize("block", [None, 7])
def test_bootstrap_draws_whole_blocks_over_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(validation, "CHUNK", 10)
    rng = np.random.default_rng(3)
    df = pd.concat([pd.DataFrame({"series_id": k, "t": np.arange(n), "x": rng.normal(size=n), "z": rng.normal(size=n)}) for k, n in ((1, 7), (2, 95), (3, 40))])
    got = validation.bootstrap(spark.createDataFrame(df), Panel(), F.col("z"), {"x": F.col("x")}, 4, block)
    rows = {(r.series_id, r.replicate): r for r in got.collect()}
    expected = plain(df, spark, block, 4)
    assert len(rows) == 12
    assert {k for k, r in rows.items() if r.x is not None} == set(expected)
    for k, (slope, level) in expected.items():
        assert (rows[k]["x"], rows[k]["(Intercept)"]) == pytest.approx((slope, level), rel=1e-9)
        assert rows[k].n == (df.series_id == k[0]).sum()


def test_bootstrap_broadcasts_no_draws(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("series_id"), F.col("id").alias("t"), F.rand(1).alias("z"))
    got = validation.bootstrap(df, Panel(), F.col("z"), {"x": F.col("t")}, 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
