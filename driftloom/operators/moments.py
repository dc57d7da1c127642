"""Moments, distribution fits and residual tests: one aggregation per series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import tails
from ..functions.scalars import finite
from ..shipping import shipped
from .panel import Panel, row_numbers
from .windows import autocorrelations

TWO_PI = math.log(2 * math.pi)


def skewness(x: Column) -> Column:
    """Third central moment over the cubed sample standard deviation; null under 3 values or without spread."""
    n = F.count(x)
    return F.when((n >= 3) & (F.stddev_samp(x) > 0), F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))


def kurtosis(x: Column) -> Column:
    """Fourth central moment over the sample variance squared, less 3; null under 4 values or without spread."""
    n = F.count(x)
    return F.when((n >= 4) & (F.stddev_samp(x) > 0), (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3)


def describe(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """n, mean, sd, min, max, skewness and kurtosis of each series."""
    x = F.col(panel.value)
    return df.groupBy(*panel.keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"))


def target_summary(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Mean, sd, range and correlation with the row index, with a verdict on the trend."""
    d = row_numbers(df, panel)
    x = F.col(panel.value)
    s = d.groupBy(*panel.keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.corr("rn", x).alias("trend"))
    r = F.abs("trend")
    return s.withColumn("verdict", F.when(r > 0.7, "strong trend").when(r > 0.3, "moderate trend").otherwise("no trend"))


def ljung_box(df: DataFrame, panel: Panel = Panel(), most: int = 10) -> DataFrame:
    """Q = n(n+2) sum r_k^2/(n-k) over min(most, n/5) lags, for series of at least 10 rows."""
    n = df.groupBy(*panel.keys).agg(F.count(F.lit(1)).alias("n")).withColumn("df", F.least(F.lit(most), F.floor(F.col("n") / 5)).cast("int")).filter("n >= 10")
    acf = autocorrelations(df, panel, most).join(n, list(panel.keys)).filter("lag <= df")
    q = acf.groupBy(*panel.keys, "n", "df").agg(F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("s"))
    return q.select(*panel.keys, "df", (F.col("n") * (F.col("n") + 2) * F.col("s")).alias("statistic"))


def arch(df: DataFrame, panel: Panel = Panel(), most: int = 5) -> DataFrame:
    """n * R^2 of the regression of squares on the min(most, n/10) squares before them, for series of at least 20 rows.

    Returns keys, df (the number of lags), statistic. Sums of products are one aggregation;
    lags that a short series does not use are zero columns, which a minimum-norm solve skips.
    """
    x2, k = F.col(panel.value) * F.col(panel.value), most + 1
    d = row_numbers(df, panel).withColumn("df", F.least(F.lit(most), F.floor(F.col("n") / 10)).cast("int"))
    lags = {f"_x{i}": F.when(F.col("df") >= i, F.lag(x2, i).over(panel.order)).otherwise(0.0) for i in range(1, k)}
    d = d.withColumns({"_x0": F.lit(1.0), "_y": x2, **lags}).filter((F.col("n") >= 20) & (F.col("rn") > F.col("df")))
    xs = [F.col(f"_x{i}") for i in range(k)]
    sums = [F.sum(xs[i] * xs[j]).alias(f"_m{i}_{j}") for i in range(k) for j in range(k)] + [F.sum(xs[i] * F.col("_y")).alias(f"_v{i}") for i in range(k)]
    m = d.groupBy(*panel.keys, "df", F.col("n").cast("long").alias("n")).agg(F.sum(F.col("_y") * F.col("_y")).alias("_yy"), *sums)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xx = b[[f"_m{i}_{j}" for i in range(k) for j in range(k)]].to_numpy(float).reshape(-1, k, k)
            xy, yy, out = b[[f"_v{i}" for i in range(k)]].to_numpy(float), b["_yy"].to_numpy(float), []
            for a, v, total in zip(xx, xy, yy, strict=True):
                scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
                beta = np.linalg.lstsq(a / scale[:, None] / scale, v / scale, rcond=1e-12)[0] / scale
                spread = total - v[0] ** 2 / a[0, 0]
                out.append(1 - (total - beta @ v) / spread if spread > 0 else np.nan)
            yield b[[*panel.keys, "df"]].assign(statistic=b["n"].to_numpy(float) * np.array(out, dtype=float))

    return shipped(m).mapInPandas(solve, StructType(list(m.select(*panel.keys, "df").schema.fields)).add("statistic", "double"))


def breusch_pagan(df: DataFrame, panel: Panel, residual: str, predictors: str | list[str]) -> DataFrame:
    """n * R^2 of the regression of squared residuals (about their fit on the predictors) on the predictors; df is their number."""
    from .regression import least_squares

    names, keys = [predictors] if isinstance(predictors, str) else list(predictors), list(panel.keys)
    terms = {p: F.col(p) for p in names}
    fit = least_squares(df, keys, F.col(residual), terms)
    fit = fit.select(*keys, F.col("(Intercept)").alias("_b"), *[F.col(f"`{p}`").alias(f"_b_{p}") for p in names])
    e = F.col(residual) - F.col("_b")
    for p in names:
        e = e - F.col(f"_b_{p}") * F.col(p)
    second = least_squares(df.join(fit, keys).withColumn("_e2", e * e), keys, F.col("_e2"), terms)
    return second.select(*keys, F.lit(len(names)).alias("df"), (F.col("n") * (1 - F.col("rss") / F.nullif(F.col("tss"), F.lit(0.0)))).alias("statistic"))


def jarque_bera(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """n/6 (S^2 + K^2/4) with population moments, and exp(-JB/2), its tail."""
    x = F.col(panel.value)
    jb = F.count(x) / 6 * (F.pow(F.skewness(x), 2) + F.pow(F.kurtosis(x), 2) / 4)
    return df.groupBy(*panel.keys).agg(jb.alias("statistic"), F.count(x).alias("n")).filter("n >= 10").select(*panel.keys, "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"))


def runs(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """z of the number of runs above and below the median; null if its variance is not positive."""
    median = df.groupBy(*panel.keys).agg(F.percentile(panel.value, 0.5).alias("_med"))
    d = df.join(median, list(panel.keys)).withColumn("_up", (F.col(panel.value) > F.col("_med")).cast("int"))
    d = d.withColumn("_new", F.coalesce((F.col("_up") != F.lag("_up").over(panel.order)).cast("int"), F.lit(1)))
    s = d.groupBy(*panel.keys).agg(F.sum("_new").alias("r"), F.sum("_up").cast("double").alias("n1"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("n2", F.col("n") - F.col("n1"))
    pq = 2 * F.col("n1") * F.col("n2")
    var = pq * (pq - F.col("n")) / (F.col("n") * F.col("n") * F.nullif(F.col("n") - 1, F.lit(0.0)))
    s = s.withColumn("var", var)
    return s.select(*panel.keys, F.col("r").cast("long").alias("runs"), F.when(F.col("var") > 0, (F.col("r") - (pq / F.col("n") + 1)) / F.sqrt(F.when(F.col("var") > 0, F.col("var")))).alias("statistic"))


def diagnostics(df: DataFrame, panel: Panel = Panel(), predictors: list[str] | None = None) -> DataFrame:
    """Rows (keys, test, statistic, p_value): Ljung-Box, ARCH, Jarque-Bera, runs, and Breusch-Pagan if there are predictors."""
    keys = list(panel.keys)

    def chi2(d: DataFrame, name: str) -> DataFrame:
        return d.select(*keys, F.lit(name).alias("test"), "statistic", tails.chi2_tail(F.col("statistic"), F.col("df")).alias("p_value"))

    out = chi2(ljung_box(shipped(df), panel), "Ljung-Box").unionByName(chi2(arch(df, panel), "ARCH"))
    out = out.unionByName(jarque_bera(df, panel).select(*keys, F.lit("Jarque-Bera").alias("test"), "statistic", "p_value"))
    out = out.unionByName(runs(df, panel).select(*keys, F.lit("Runs").alias("test"), "statistic", tails.normal_tails(F.col("statistic")).alias("p_value")))
    return out if not predictors else out.unionByName(chi2(breusch_pagan(df, panel, panel.value, predictors), "Breusch-Pagan"))


def issues(tests: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Per key the tests of ``diagnostics`` whose p-value is below ``alpha``, in order of name."""
    found = F.sort_array(F.collect_list(F.when(F.col("p_value") < alpha, F.col("test"))))
    return tests.groupBy(*keys).agg(found.alias("issues"))


def normal_fit(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Log-likelihood and AIC of the normal distribution at the sample mean and sd."""
    x = F.col(panel.value)
    n, s = F.count(x), F.stddev_samp(x)
    loglik = -n / 2 * TWO_PI - n * F.ln(F.nullif(s, F.lit(0.0))) - (n - 1) / 2
    return df.groupBy(*panel.keys).agg(loglik.alias("loglik"), F.avg(x).alias("mean"), s.alias("sd")).withColumn("aic", 4 - 2 * F.col("loglik"))


def t_fit(df: DataFrame, panel: Panel = Panel(), degrees: tuple[int, ...] = (2, 3, 4, 5, 7, 10, 15, 20, 30, 50)) -> DataFrame:
    """Log-likelihood of the t distribution at the sample mean and sd, for the best of a few degrees of freedom."""
    x = F.col(panel.value)
    d = df.withColumn("_u", (x - F.avg(x).over(panel.whole)) / F.nullif(F.stddev_samp(x).over(panel.whole), F.lit(0.0))).withColumn("_s", F.stddev_samp(x).over(panel.whole))
    const = {v: math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) for v in degrees}
    each = [F.sum(F.lit(const[v]) - (v + 1) / 2 * F.log1p(F.col("_u") * F.col("_u") / v) - F.ln("_s")).alias(f"_{v}") for v in degrees]
    s = d.groupBy(*panel.keys).agg(*each)
    best = F.array_max(F.array(*[F.struct(F.col(f"_{v}").alias("loglik"), F.lit(-v).alias("nu")) for v in degrees]))
    return s.select(*panel.keys, (-best["nu"]).alias("nu"), best["loglik"].alias("loglik"))


def weighted_deviance(df: DataFrame, keys: list[str], target: str, fitted: str, weight: str) -> DataFrame:
    """Weighted mean of squared errors over rows where target, fit and weight are finite; infinite if none is."""
    y, f, w = finite(F.col(target)), finite(F.col(fitted)), finite(F.col(weight))
    ok = y.isNotNull() & f.isNotNull() & w.isNotNull()
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(ok, w * (y - f) * (y - f))) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0)), F.lit(float("inf"))).alias("deviance"))


def iterate_change(df: DataFrame, keys: list[str], new: str, old: str, weight: str) -> DataFrame:
    """Weighted root mean square of new - old, relative to that of old."""
    move, size = F.col(new) - F.col(old), F.col(old)
    rms = lambda v: F.sqrt(F.sum(F.col(weight) * v * v) / F.sum(weight))
    return df.groupBy(*keys).agg((rms(move) / (rms(size) + 1e-12)).alias("change"))


def fit_statistics(df: DataFrame, keys: list[str], target: str, fitted: str, k: int) -> DataFrame:
    """n, R^2, adjusted R^2, RMSE, MAE, AIC and BIC of a fit with ``k`` coefficients."""
    y, e = F.col(target), F.col(target) - F.col(fitted)
    s = df.groupBy(*keys).agg(F.count(y).alias("n"), F.sum(e * e).alias("rss"), F.var_pop(y).alias("_v"), F.avg(F.abs(e)).alias("mae"))
    n, rss = F.col("n"), F.col("rss")
    r2 = 1 - rss / F.nullif(n * F.col("_v"), F.lit(0.0))
    loglik = n * (F.ln(F.when(rss > 0, rss) / n) + TWO_PI + 1)
    s = s.withColumn("r_squared", r2)
    return s.select(*keys, "n", "r_squared", (1 - (1 - F.col("r_squared")) * (n - 1) / F.nullif(n - k, F.lit(0))).alias("adj_r_squared"), F.sqrt(rss / n).alias("rmse"), "mae", (loglik + 2 * (k + 1)).alias("aic"), (loglik + F.ln(n) * (k + 1)).alias("bic"))
