"""Derivatives of series: differences, local polynomials, Fourier, splines and total variation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from . import banded
from .panel import Panel, row_numbers


def finite_difference(df: DataFrame, panel: Panel = Panel(), out: str = "d_z", value: str | None = None) -> DataFrame:
    """Central differences inside, one-sided ones at the ends; unequal spacing enters by the quotient only."""
    z, t, w = F.col(value or panel.value), F.col(panel.time), panel.order
    ahead = lambda c: F.coalesce(F.lead(c).over(w), c)
    behind = lambda c: F.coalesce(F.lag(c).over(w), c)
    return df.withColumn(out, (ahead(z) - behind(z)) / F.nullif(ahead(t) - behind(t), F.lit(0.0)))


def savgol_weights(degree: int, width: int, order: int = 1) -> np.ndarray:
    """Rows of weights for each place in a window of ``width`` points: the middle row is the usual filter."""
    half = width // 2
    x = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    fit = np.linalg.pinv(x)
    at = np.arange(-half, half + 1)[:, None].astype(float)
    powers = np.arange(degree + 1)
    factor = np.array([np.prod(np.arange(p, p - order, -1)) if p >= order else 0 for p in powers])
    return (factor * at ** np.maximum(powers - order, 0)) @ fit


def savitzky_golay(df: DataFrame, panel: Panel = Panel(), degree: int = 3, width: int = 11, out: str = "d_z") -> DataFrame:
    """Derivative of the polynomial fitted to the ``width`` points around each point.

    At the ends the polynomial of the first or last full window is differentiated there.
    Series shorter than the window get null. The time step is the mean one.
    """
    width += 1 - width % 2
    half, rows = width // 2, savgol_weights(degree, width)
    w = panel.order
    near = F.collect_list(F.col(panel.value)).over(panel.frame(-2 * half, 2 * half))
    t = F.col(panel.time)
    d = row_numbers(df, panel).withColumn("_step", (F.max(t).over(panel.whole) - F.min(t).over(panel.whole)) / F.nullif(F.col("n") - 1, F.lit(0)))
    d = d.withColumn("_near", near)
    # Place of the row in the window it uses, and where that window starts in _near.
    place = F.when(F.col("rn") <= half, F.col("rn") - 1).when(F.col("rn") > F.col("n") - half, F.lit(width - 1) - (F.col("n") - F.col("rn"))).otherwise(F.lit(half)).cast("int")
    start = F.least(F.col("rn") - 1, F.lit(2 * half)) - F.col("_place") + 1
    weights = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows]), F.col("_place") + 1)
    d = d.withColumn("_place", place).withColumn("_used", F.slice("_near", start.cast("int"), F.lit(width)))
    total = F.aggregate(F.zip_with("_used", weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return d.withColumn(out, F.when(F.col("n") >= width, total / F.col("_step"))).drop("_near", "_used", "_place", "_step", "rn", "n")


def spectral(df: DataFrame, panel: Panel = Panel(), out: str = "d_z") -> DataFrame:
    """Derivative of the trigonometric interpolation (periodic series; the highest frequency of even ones is dropped)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(panel.time, kind="stable")
        z, t = rows[panel.value].to_numpy(float), rows[panel.time].to_numpy(float)
        n = len(z)
        omega = 2j * np.pi * np.fft.fftfreq(n, d=np.diff(t).mean() if n > 1 else 1.0)
        if n % 2 == 0:
            omega[n // 2] = 0
        return rows.assign(**{out: np.fft.ifft(omega * np.fft.fft(z)).real})

    return _per_series(df, panel, one, out)


def smoothing_spline(df: DataFrame, panel: Panel = Panel(), out: str = "d_z", penalties: int = 40, freedom: float | None = None) -> DataFrame:
    """Derivative of the natural cubic smoothing spline whose penalty minimises generalised cross-validation.

    With ``freedom`` the penalty is the one that gives the spline that many degrees of
    freedom, held between 2.001 and 0.001 less than the series' length.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(panel.time, kind="stable")
        z, t = rows[panel.value].to_numpy(float), rows[panel.time].to_numpy(float)
        return rows.assign(**{out: spline_derivative(t, z, penalties, freedom)})

    return _per_series(df, panel, one, out)


class Spline:
    """Natural cubic smoothing splines of one series; every penalty is a solve with five bands."""

    def __init__(self, t: np.ndarray, z: np.ndarray):
        self.z, self.h = z, np.diff(t)
        h, self.weights = self.h, banded.second_differences(self.h)
        a, b, c = self.weights
        self.rough, self.bend = banded.gram(a, b, c), ((h[:-1] + h[1:]) / 3, h[1:-1] / 6)
        self.turns = a * z[:-2] + b * z[1:-1] + c * z[2:]
        self.unit = self.bend[0].sum() / self.rough[0].sum() * len(z)

    def factors(self, penalty: float) -> tuple[list[float], list[float], list[float]]:
        return banded.factor((self.bend[0] + penalty * self.rough[0], self.bend[1] + penalty * self.rough[1], penalty * self.rough[2]))

    def left(self, penalty: float, factors: tuple[list[float], list[float], list[float]] | None = None) -> float:
        """Rows less the degrees of freedom, from the bands of the inverse."""
        inverse = banded.inverse_bands(factors or self.factors(penalty))
        return penalty * sum(k * float(i @ r) for k, i, r in zip((1, 2, 2), inverse, self.rough, strict=True))

    def at(self, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Score of generalised cross-validation, fitted values, and second derivatives at the inner points."""
        factors, n = self.factors(penalty), len(self.z)
        second = banded.solve(factors, self.turns)
        off = np.zeros(n)
        for k, w in enumerate(self.weights):
            off[k : n - 2 + k] += w * second
        left = self.left(penalty, factors)
        return n * penalty * penalty * float(off @ off) / max(left, 1e-9) ** 2, self.z - penalty * off, second

    def penalty_of(self, freedom: float) -> float:
        """The penalty that gives ``freedom`` degrees of freedom, by halving in its logarithm."""
        n = len(self.z)
        left = n - min(max(freedom, 2.001), n - 0.001)
        low, high = -20.0, 20.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if self.left(10.0**middle * self.unit) < left else (low, middle)
        return 10.0**high * self.unit


def spline_derivative(t: np.ndarray, z: np.ndarray, penalties: int = 40, freedom: float | None = None) -> np.ndarray:
    """Slopes of the spline at the best of ``penalties``, or at the one with the asked degrees of freedom."""
    n = len(z)
    if n < 4 or (np.diff(t) <= 0).any():
        return np.gradient(z, t) if n > 1 and (np.diff(t) > 0).all() else np.full(n, np.nan)
    s = Spline(t, z)
    tried = np.logspace(-8, 4, penalties) * s.unit if freedom is None else [s.penalty_of(freedom)]
    _, g, second = min((s.at(p) for p in tried), key=lambda found: found[0])
    h, second = s.h, np.concatenate([[0.0], second, [0.0]])
    slope = np.diff(g) / h
    return np.append(slope - h * (2 * second[:-1] + second[1:]) / 6, slope[-1] + h[-1] * (second[-2] + 2 * second[-1]) / 6)


def total_variation(df: DataFrame, panel: Panel = Panel(), penalty: float | None = None, out: str = "d_z") -> DataFrame:
    """Derivative of least total variation whose running sum follows the series.

    Minimises |(z - z1)/s - A u|^2 + penalty/s * |D u|_1 with A summing u * dt up to each
    point and s the standard deviation; the derivative is u * s. Without ``penalty`` it is
    the largest of a grid whose reconstruction error is within one standard error of the
    smallest. Times that do not rise, and values that are not finite, give NaN for the series.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(panel.time, kind="stable")
        z, t = rows[panel.value].to_numpy(float), rows[panel.time].to_numpy(float)
        return rows.assign(**{out: tv_derivative(z, t, penalty)[0]})

    return _per_series(df, panel, one, out)


def tv_derivative(z: np.ndarray, t: np.ndarray, penalty: float | None = None) -> tuple[np.ndarray, float]:
    if not (np.diff(t) > 0).all() or not np.isfinite(z).all():
        return np.full(len(z), np.nan), float("nan")
    if len(z) < 5:
        return (np.gradient(z, t) if len(z) > 1 else np.full(len(z), np.nan)), float("nan")
    if penalty is not None:
        return _tv(z, t, penalty), penalty
    grid = np.logspace(-4, 2, 30)
    found = [(_tv(z, t, p)) for p in grid]
    errors = np.array([((z - _rebuild(z[0], d, t)) ** 2).mean() for d in found])
    within = errors <= errors.min() + errors.std(ddof=1) / np.sqrt(len(errors))
    at = max(i for i in range(len(grid)) if within[i] and i >= int(errors.argmin()))
    return found[at], float(grid[at])


def _rebuild(first: float, d: np.ndarray, t: np.ndarray) -> np.ndarray:
    return first + np.concatenate([[0.0], np.cumsum(d[:-1] * np.diff(t))])


def _tv(z: np.ndarray, t: np.ndarray, penalty: float) -> np.ndarray:
    """The running sum x of u is the variable: u is its slope, so jumps of u are changes of slope of x.

    The last value of u is not in the sum; at the optimum it equals the one before.
    """
    h = np.diff(t)
    s = max(float((z - z[0]).std(ddof=1)), np.finfo(float).eps)
    slope = np.diff(banded.least_turning((z - z[0]) / s, h, penalty / s / 2)) / h
    return np.append(slope, slope[-1]) * s


def derivative(df: DataFrame, panel: Panel = Panel(), method: str = "tvr", out: str = "d_z", **options) -> DataFrame:
    """Derivative by name: tvr, savgol, spline, finite_diff (or fd), spectral."""
    methods = {"tvr": total_variation, "savgol": savitzky_golay, "spline": smoothing_spline, "finite_diff": finite_difference, "fd": finite_difference, "spectral": spectral}
    if method not in methods:
        raise ValueError(f"method must be one of {sorted(methods)}")
    return methods[method](df, panel, out=out, **options)


def derivatives(df: DataFrame, panel: Panel, method: str = "finite_diff", prefix: str = "d_") -> DataFrame:
    """A derivative column for every modelled variable of the panel."""
    from dataclasses import replace

    for name in panel.modelled:
        df = derivative(df, replace(panel, value=name), method, out=f"{prefix}{name}")
    return df


def compare_methods(df: DataFrame, panel: Panel = Panel(), methods: tuple[str, ...] = ("tvr", "savgol", "spline", "finite_diff")) -> DataFrame:
    """Rows (keys, time, method, derivative): the series' derivative by each method."""
    for m in methods:
        df = derivative(df, panel, m, out=f"_{m}")
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_{m}").alias("derivative")) for m in methods])
    return df.select(*panel.keys, panel.time, F.inline(pairs))


def reconstruct(df: DataFrame, panel: Panel = Panel(), rate: str = "d_z", out: str = "z_hat") -> DataFrame:
    """First value plus the running left sum of ``rate`` times the time step."""
    t = F.col(panel.time)
    step = F.lead(t).over(panel.order) - t
    d = df.withColumn("_part", F.col(rate) * step)
    total = F.coalesce(F.sum("_part").over(panel.order.rowsBetween(-(2**63), -1)), F.lit(0.0))
    first = F.first(panel.value).over(panel.order.rowsBetween(-(2**63), 0))
    return d.withColumn(out, first + total).drop("_part")


def _per_series(df: DataFrame, panel: Panel, one, out: str) -> DataFrame:
    """A kernel on each series. Its rows come to one task, so it is for series of bounded length."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    return shipped(df).groupBy(*panel.keys).applyInPandas(one, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def suggest_method(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Per series what speaks for a method: trend (Kendall), periodicity, shocks, noise; and the method."""
    from .windows import autocorrelations, kendall

    rows = row_numbers(df, panel)
    z, w = F.col(panel.value), panel.order
    rows = rows.withColumn("d1", z - F.lag(z).over(w)).withColumn("d2", F.col("d1") - F.lag(F.col("d1")).over(w))
    middle = rows.groupBy(*panel.keys).agg(F.percentile("d1", 0.5).alias("med"))
    rows = rows.join(middle, list(panel.keys))
    spread = rows.groupBy(*panel.keys).agg(F.first("med").alias("med"), (F.percentile(F.abs(F.col("d1") - F.col("med")), 0.5) * 1.4826).alias("mad"), (F.stddev_samp("d2") / F.nullif(F.stddev_samp("d1"), F.lit(0.0))).alias("noise"))
    shocks = rows.drop("med").join(spread, list(panel.keys)).groupBy(*panel.keys).agg(F.count_if(F.abs(F.col("d1") - F.col("med")) > 4 * F.col("mad")).alias("n_shocks"), F.first("noise").alias("noise_ratio"), F.count(F.lit(1)).alias("n"))
    acf = autocorrelations(df, panel, 50).join(shocks.select(*panel.keys, "n"), list(panel.keys))
    longest = F.least(F.floor(F.col("n") / 3), F.lit(50))
    periodic = acf.filter((F.col("lag") <= longest) & (F.col("lag") >= F.least(F.lit(10), longest))).groupBy(*panel.keys).agg(F.max(F.abs("acf")).alias("peak"))
    found = shocks.join(kendall(df, panel), list(panel.keys)).join(periodic, list(panel.keys), "left")
    trend, noisy = F.col("tau") > 0.3, F.col("noise_ratio") > 0.5
    method = F.when((F.col("n_shocks") > 0) | trend, "tvr").when((F.col("peak") > 0.5) & ~noisy, "savgol").when(noisy, "spline").otherwise("finite_diff")
    return found.select(*panel.keys, "n", "tau", "peak", "n_shocks", "noise_ratio", method.alias("method"))
