"""Regression on panels: normal equations from one aggregation, small solves on the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equations import Equation
from ..shipping import shipped
from .panel import Panel
from .smooth import additive


def centred_moments(df: DataFrame, keys: list[str], columns: list[Column], weight: Column | None = None) -> DataFrame:
    """Per key: n, mass, means ``_m<i>`` and centred sums of products ``_s<i>_<j>`` of the columns, over rows where all are given.

    Without weights one aggregation of mergeable moments; with weights the means come first
    and go back to the rows. Sums of raw products, which lose all digits when data lie far
    from zero, are never formed.
    """
    k = len(columns)
    weigh = [] if weight is None else [weight.cast("double").alias("_w")]
    rows = df.select(*keys, *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(columns)], *weigh)
    whole = F.lit(True)
    for c in rows.columns[len(keys) :]:
        whole = whole & F.col(c).isNotNull()
    rows = rows.withColumn("_ok", whole)
    v = [F.when(F.col("_ok"), F.col(f"_v{i}")) for i in range(k)]
    n = F.count_if("_ok")
    if weight is None:
        sums = [(F.covar_pop(v[i], v[j]) * n).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]
        return rows.groupBy(*keys).agg(n.alias("n"), n.cast("double").alias("mass"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(v)], *sums)
    w = F.when(F.col("_ok"), F.col("_w"))
    means = rows.groupBy(*keys).agg(*[(F.sum(w * c) / F.sum(w)).alias(f"_m{i}") for i, c in enumerate(v)])
    near = rows.join(means, keys) if keys else rows.crossJoin(F.broadcast(means))
    e = [c - F.col(f"_m{i}") for i, c in enumerate(v)]
    # What the rounding of the means leaves over is taken out of the sums again.
    sums = [(F.sum(w * e[i] * e[j]) - F.sum(w * e[i]) * F.sum(w * e[j]) / F.sum(w)).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]
    return near.groupBy(*keys).agg(n.alias("n"), F.sum(w).alias("mass"), *[(F.first(f"_m{i}") + F.sum(w * e[i]) / F.sum(w)).alias(f"_m{i}") for i in range(k)], *sums)


def moment_arrays(b: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means (groups, k) and centred sums of products (groups, k, k) of a batch of ``centred_moments``."""
    m, s = np.zeros((len(b), k)), np.zeros((len(b), k, k))
    for i in range(k):
        m[:, i] = b[f"_m{i}"].to_numpy(float)
        for j in range(i, k):
            s[:, i, j] = s[:, j, i] = b[f"_s{i}_{j}"].to_numpy(float)
    return m, s


def solve_centred(mean: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Coefficients (intercept first), the inverse of the centred products, and rss, of column 0 on the others; None if these are dependent.

    Products are scaled to correlations first; terms count as dependent when the smallest
    singular value of the scaled terms is below 1e-6.
    """
    sxx, sxy = s[1:, 1:], s[1:, 0]
    if not np.isfinite(s).all() or not np.isfinite(mean).all():
        return None
    scale = np.sqrt(np.maximum(np.diag(sxx), 0.0))
    if len(scale) and not (scale > 1e-14 * np.abs(mean[1:])).all():
        return None
    unit = sxx / scale[:, None] / scale
    if len(scale) and np.linalg.eigvalsh(unit)[0] < 1e-12:
        return None
    slopes = np.linalg.solve(unit, sxy / scale) / scale if len(scale) else np.zeros(0)
    inverse = np.linalg.inv(unit) / scale[:, None] / scale if len(scale) else np.zeros((0, 0))
    return np.r_[mean[0] - slopes @ mean[1:], slopes], inverse, max(float(s[0, 0] - slopes @ sxy), 0.0)


def least_squares(df: DataFrame, keys: list[str], target: Column, terms: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Weighted least squares with intercept of ``target`` on ``terms``, one fit per key.

    Centred sums of products are aggregated; only those, one row per key, are solved, in
    batches. Rows with a null in a column are left out. Returns keys, n, rss, tss, one
    column per coefficient (``(Intercept)`` first) and its standard error ``se_<name>``;
    null where the terms are not independent.
    """
    names, k = ["(Intercept)", *terms], len(terms) + 1
    moments = centred_moments(df, keys, [target, *terms.values()], weight)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means, sums = moment_arrays(b, k)
            n, mass = b["n"].to_numpy(float), b["mass"].to_numpy(float)
            beta, se, rss = np.full((len(b), k), np.nan), np.full((len(b), k), np.nan), np.full(len(b), np.nan)
            for g in range(len(b)):
                got = solve_centred(means[g], sums[g])
                if got is None:
                    continue
                beta[g], inverse, rss[g] = got
                if n[g] > k:
                    spread = np.r_[1 / mass[g] + means[g, 1:] @ inverse @ means[g, 1:], np.diag(inverse)]
                    se[g] = np.sqrt(np.maximum(spread, 0) * rss[g] / (n[g] - k))
            out = b[[*keys, "n"]].assign(rss=rss, tss=sums[:, 0, 0])
            for i, name in enumerate(names):
                out[name], out[f"se_{name}"] = beta[:, i], se[:, i]
            yield out

    schema = moments.select(*keys, "n").schema.add("rss", "double").add("tss", "double")
    for name in names:
        schema = schema.add(name, "double").add(f"se_{name}", "double")
    fitted = shipped(moments).mapInPandas(solve, schema)
    return fitted.select(*keys, "n", *[F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) for c in ["rss", "tss", *(x for n in names for x in (n, f"se_{n}"))]])


def coefficient_table(fit: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows (keys, term, estimate, std_error, lower, upper) with 1.96 standard errors to each side."""
    rows = F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"`{n}`").alias("estimate"), F.col(f"`se_{n}`").alias("std_error")) for n in names])
    t = fit.select(*keys, F.inline(rows))
    return t.withColumn("lower", F.col("estimate") - 1.96 * F.col("std_error")).withColumn("upper", F.col("estimate") + 1.96 * F.col("std_error"))


def predict(df: DataFrame, equation: Equation, out: str = "prediction") -> DataFrame:
    """``df`` with what the equation gives for each row."""
    missing = equation.free(df.columns)
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return df.withColumn(out, equation.column())


def residuals(df: DataFrame, equation: Equation, target: str | None = None, out: str = "residual") -> DataFrame:
    """Target less prediction; the target is the equation's or the only column named like a derivative."""
    from .panel import derivative_column

    return df.withColumn(out, F.col(target or equation.target or derivative_column(df)) - equation.column())


def start_values(df: DataFrame, equation: Equation, target: str, tries: tuple[float, ...] = (-10.0, -1.0, -0.1, 0.1, 1.0, 10.0), chunk: int = 216) -> dict[str, float]:
    """Of all combinations of ``tries`` for the free names, the first with the smallest mean squared error.

    Combinations are columns of an aggregation, ``chunk`` at a time; the data are not copied.
    """
    free = equation.free(df.columns)
    if not free:
        raise ValueError("the equation has no free names")
    grid = [[]]
    for _ in free:
        grid = [g + [v] for g in grid for v in tries]
    best: tuple[float, list[float]] | None = None
    for at in range(0, len(grid), chunk):
        part = grid[at : at + chunk]
        errors = [F.avg(F.pow(F.col(target) - Equation(equation.text, equation.coefficients | dict(zip(free, g, strict=True))).column(), F.lit(2.0))).alias(f"m{i}") for i, g in enumerate(part)]
        for g, e in zip(part, df.agg(*errors).first(), strict=True):
            if e is not None and np.isfinite(e) and (best is None or e < best[0]):
                best = (e, g)
    return dict(zip(free, best[1] if best else [0.1] * len(free), strict=True))


def fit_equation(df: DataFrame, equation: Equation, target: str, start: dict[str, float] | None = None, rounds: int = 100, weight: Column | None = None) -> Equation:
    """Nonlinear least squares for the free names by damped Gauss-Newton steps.

    Each step is one aggregation of the products of numerical derivatives over all rows,
    so the data stay where they are; only the small system is solved here.
    """
    values = dict(start or start_values(df, equation, target))
    names, w, y = list(values), weight if weight is not None else F.lit(1.0), F.col(target)

    def at(v: dict[str, float]) -> Column:
        return Equation(equation.text, equation.coefficients | v).column()

    def loss(v: dict[str, float]) -> float:
        got = df.agg(F.sum(w * (y - at(v)) * (y - at(v)))).first()[0]
        return got if got is not None and np.isfinite(got) else np.inf

    damping, now = 1e-3, loss(values)
    for _ in range(rounds):
        step = {n: 1e-6 * max(abs(values[n]), 1e-3) for n in names}
        slope = {n: (at(values | {n: values[n] + step[n]}) - at(values | {n: values[n] - step[n]})) / (2 * step[n]) for n in names}
        gaps = y - at(values)
        sums = df.agg(*[F.sum(w * slope[a] * slope[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)], *[F.sum(w * slope[a] * gaps).alias(f"g{i}") for i, a in enumerate(names)]).first()
        k = len(names)
        jj, g = np.array(sums[: k * k], dtype=float).reshape(k, k), np.array(sums[k * k :], dtype=float)
        if not np.isfinite(jj).all() or not np.isfinite(g).all():
            break
        for _ in range(8):
            move = np.linalg.lstsq(jj + damping * np.diag(np.maximum(np.diag(jj), 1e-12)), g, rcond=None)[0]
            trial = {n: values[n] + float(m) for n, m in zip(names, move, strict=True)}
            then = loss(trial)
            if then < now:
                damping = max(damping / 10, 1e-12)
                break
            damping *= 10
        else:
            break
        done = now - then <= 1e-12 * (abs(now) + 1e-12)
        values, now = trial, then
        if done:
            break
    return Equation(equation.text, equation.coefficients | values, target)


def variance_model(df: DataFrame, keys: list[str], residual: str, predictors: list[str], transform: str = "absolute", method: str = "linear") -> DataFrame:
    """Fit of the residuals' size (absolute, squared or log_squared) on nothing, the predictors, also their squares, or smooths of them (gam)."""
    r = F.col(residual)
    size = {"absolute": F.abs(r), "squared": r * r, "log_squared": F.ln(r * r + 1e-10)}[transform]
    return size_fit(df, keys, size, predictors, method)


def size_fit(df: DataFrame, keys: list[str], size: Column, predictors: list[str], method: str) -> DataFrame:
    """A row of ``least_squares`` per key for constant, linear and quadratic fits, a row of ``additive`` for gam."""
    if method not in ("constant", "linear", "quadratic", "gam"):
        raise ValueError(f"unknown method {method}")
    if method == "gam":
        return additive(df, keys, size, predictors)
    terms = {} if method == "constant" else {p: F.col(p) for p in predictors}
    if method == "quadratic":
        terms |= {f"{p}^2": F.col(p) * F.col(p) for p in predictors}
    return least_squares(df, keys, size, terms)


def diffusion_model(df: DataFrame, panel: Panel, predictors: list[str], method: str = "linear", window: int = 21) -> DataFrame:
    """Fit, for every series, of the local diffusion that ``quadratic_variation`` finds on the predictors.

    Predictions are of the diffusion itself, so ``to_sd(prediction, "absolute")`` gives it.
    """
    return size_fit(quadratic_variation(df, panel, window), list(panel.keys), F.col("diffusion"), predictors, method)


def to_sd(prediction: Column, transform: str) -> Column:
    """Standard deviation from a prediction of a residual's size."""
    above = F.greatest(prediction, F.lit(0.0))
    return {"absolute": above, "squared": F.sqrt(above), "log_squared": F.sqrt(F.exp(prediction))}[transform]


def quadratic_variation(df: DataFrame, panel: Panel = Panel(), window: int = 21) -> DataFrame:
    """Local diffusion: root of the rolling median of squared increments over their time steps.

    The last row, which has no increment, takes the value before it.
    """
    from .windows import middle

    t, z, half = F.col(panel.time), F.col(panel.value), max(3, window + 1 - window % 2) // 2
    dz, dt = F.lead(z).over(panel.order) - z, F.lead(t).over(panel.order) - t
    d = df.withColumn("_qv", dz * dz / F.nullif(dt, F.lit(0.0)))
    d = d.withColumn("_m", middle(F.collect_list("_qv").over(panel.frame(-half, half))))
    g = F.sqrt(F.greatest(F.when(F.col("_qv").isNotNull(), F.col("_m")), F.lit(0.0)))
    d = d.withColumn("_g", F.when(F.col("_qv").isNotNull(), g))
    return d.withColumn("diffusion", F.coalesce("_g", F.lag("_g").over(panel.order))).drop("_qv", "_m", "_g")
