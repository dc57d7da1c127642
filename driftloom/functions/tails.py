"""Upper tails of the distributions that tests refer to, as vectorised functions of columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): a series for small x, else a continued fraction."""
    if math.isnan(a) or math.isnan(x) or a <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction."""
    if math.isnan(x) or a <= 0 or b <= 0:
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _vector(f, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def tail(*xs: pd.Series) -> pd.Series:
        return pd.Series([math.nan if any(v is None or v != v for v in row) else f(*row) for row in zip(*xs, strict=True)], dtype="float64")

    return tail(*columns)


def chi2_tail(x: Column, df: Column) -> Column:
    return _vector(chi2, x.cast("double"), df.cast("double"))


def f_upper_tail(x: Column, d1: Column, d2: Column) -> Column:
    return _vector(f_tail, x.cast("double"), d1.cast("double"), d2.cast("double"))


def normal_tails(z: Column) -> Column:
    return _vector(normal_two_sided, z.cast("double"))
