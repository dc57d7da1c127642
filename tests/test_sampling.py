"""Diagnosis of sampling: known cycles, slow series, plain sums, edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import sampling


def series(**named):
    return pd.concat([pd.DataFrame({"series_id": k, "t": t, "z": z}) for k, (t, z) in named.items()])


def test_sizes_are_products_of_small_primes():
    assert [sampling.next_size(n) for n in (1, 7, 11, 17, 31, 97, 101, 1000, 1001)] == [1, 8, 12, 18, 32, 100, 108, 1000, 1024]


def test_periodogram_equals_plain_sums():
    z = np.random.default_rng(1).normal(size=53) + 0.1 * np.arange(53)
    frequency, power = sampling.periodogram(z)
    at = np.arange(53)
    x = z - np.polyval(np.polyfit(at, z, 1), at)
    for i in range(5):
        w = 0.5 * (1 - np.cos(np.pi * (2 * i + 1) / 10))
        x[i] *= w
        x[52 - i] *= w
    for f, p in zip(frequency, power, strict=True):
        assert p == pytest.approx(abs((x * np.exp(-2j * np.pi * f * at)).sum()) ** 2 / 53 / 0.875, rel=1e-9)
    assert frequency[0] == 1 / 54 and len(frequency) == 27


def test_cycles_and_verdicts(spark):
    t = np.arange(200.0)
    rng = np.random.default_rng(2)
    d = series(
        slow=(t, np.sin(2 * np.pi * t / 100)),
        fast=(t, np.sin(2 * np.pi * t / 2.5) + 0.01 * rng.normal(size=200)),
        good=(t, np.sin(2 * np.pi * t / 10) + 0.3 * rng.normal(size=200)),
        uneven=(np.sort(rng.uniform(0, 200, 200)), rng.normal(size=200)),
    )
    got = {r.series_id: r for r in sampling.diagnose_sampling(spark.createDataFrame(d.sample(frac=1, random_state=1))).collect()}
    assert got["slow"].oversampled and got["slow"].recommendation == sampling.ADVICE[0] and got["slow"].dominant_frequency == pytest.approx(0.01, abs=0.003)
    assert got["fast"].aliasing_risk and got["fast"].nyquist_ok and got["fast"].samples_per_cycle == pytest.approx(2.5, abs=0.05)
    assert got["good"].samples_per_cycle == pytest.approx(10, abs=0.5) and got["good"].recommendation == sampling.ADVICE[2]
    assert got["good"].uniform_sampling and not got["uneven"].uniform_sampling and len(got["good"].acf) == 20


def test_edges_of_the_diagnosis(spark):
    t = np.arange(8.0)
    d = series(flat=(t, np.ones(8)), short=(t[:3], t[:3]), still=(np.zeros(8), t**2), hole=(t, np.where(t == 3, np.nan, t)))
    got = {r.series_id: r for r in sampling.diagnose_sampling(spark.createDataFrame(d)).collect()}
    assert got["flat"].acf == [None, None] and got["flat"].oversampled is False and got["short"].mean_dt is None and got["short"].n == 3
    assert got["still"].samples_per_cycle is None and got["still"].dominant_frequency > 0 and got["hole"].acf is None
    assert sampling.diagnose_sampling(spark.createDataFrame(d).filter(F.lit(False))).count() == 0
