"""Is a series sampled often enough, or too often, for what it does?"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import shipped
from .panel import Panel

ADVICE = ("Consider subsampling data", "Sample more frequently to avoid aliasing", "Sampling frequency appears adequate")


def next_size(n: int) -> int:
    """The least product of twos, threes and fives that is n or more."""
    while True:
        rest = n
        for f in (2, 3, 5):
            while rest > 1 and rest % f == 0:
                rest //= f
        if rest <= 1:
            return n
        n += 1


def periodogram(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (cycles a sample, from the first above zero) and power of a series.

    A line is taken out, a tenth of the rows at each end is tapered by a cosine, and zeros
    are added up to a size that is fast to transform.
    """
    n = len(z)
    at = np.arange(n) - (n - 1) / 2
    x = z - z.mean()
    x = x - (x @ at) / (at @ at) * at
    m = n // 10
    if m:
        rise = 0.5 * (1 - np.cos(np.pi * np.arange(1, 2 * m, 2) / (2 * m)))
        x[:m] *= rise
        x[n - m :] *= rise[::-1]
    size = next_size(n)
    power = np.abs(np.fft.rfft(x, size)[1 : size // 2 + 1]) ** 2 / (n * (1 - 0.625 * 0.2))
    return np.arange(1, size // 2 + 1) / size, power


def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelations at lags 1 to ``lags``, all over the sum at lag zero; NaN for a constant."""
    e = x - x.mean()
    zero = float(e @ e)
    if not zero > 1e-24 * max(float(x @ x), 1e-300):
        return np.full(lags, np.nan)
    return np.array([e[k:] @ e[:-k] for k in range(1, lags + 1)]) / zero


def diagnose_sampling(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Per series: evenness of its times, decay of its differences' autocorrelations, and samples to a cycle of its strongest frequency.

    Even: squared variation of the steps under 0.01. Oversampled: the fifth autocorrelation
    of differences is over 0.8 of the first, which is over 0.5. Aliasing risk: fewer than
    four samples a cycle; ``nyquist_ok``: at least two. Samples a cycle are one over the
    product of the frequency in cycles a sample and the mean step.

    A series is transformed in one task, so it must fit there. With under four rows, or a
    null or non-finite value or time, all but n is null; so are the samples of a series
    without any step in time.
    """
    keys, t, z = list(panel.keys), panel.time, panel.value

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_t", kind="stable")
        v, at, n = rows["_z"].to_numpy(float), rows["_t"].to_numpy(float), len(rows)
        found: dict[str, object] = dict.fromkeys(NAMES) | {"n": n}
        if n >= 4 and np.isfinite(v).all() and np.isfinite(at).all():
            dt = np.diff(at)
            mean = float(dt.mean())
            lags = min(20, n // 4, n - 2)
            acf = autocorrelations(np.diff(v), lags)
            over = bool(lags >= 5 and abs(acf[4]) > 0.8 * abs(acf[0]) and acf[0] > 0.5)
            frequency, power = periodogram(v)
            peak = float(frequency[int(np.argmax(power))])
            found |= {"mean_dt": mean, "acf": [None if np.isnan(a) else float(a) for a in acf], "oversampled": over, "dominant_frequency": peak}
            if mean > 0:
                cv, samples = float(dt.std(ddof=1)) / mean, 1 / (peak * mean)
                advice = ADVICE[0 if over else 1 if samples < 4 else 2]
                found |= {"dt_cv": cv, "uniform_sampling": cv * cv < 0.01, "samples_per_cycle": samples, "nyquist_ok": samples >= 2, "aliasing_risk": samples < 4, "recommendation": advice}
        out = pd.DataFrame([{k: rows[k].iloc[0] for k in keys} | found])
        return out

    schema = StructType(df.select(*keys).schema.fields + StructType.fromDDL(FIELDS).fields)
    series = df.select(*keys, F.col(t).cast("double").alias("_t"), F.col(z).cast("double").alias("_z"))
    return shipped(series).groupBy(*keys).applyInPandas(one, schema)


FIELDS = "n long, mean_dt double, dt_cv double, uniform_sampling boolean, acf array<double>, oversampled boolean, dominant_frequency double, samples_per_cycle double, nyquist_ok boolean, aliasing_risk boolean, recommendation string"
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]
