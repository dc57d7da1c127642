"""Comparing and validating equations, and stochastic models of what they leave over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.equations import Equation
from ..operators import dynamics, moments, refit, validation
from ..operators.lineage import settled
from ..operators.panel import Panel
from ..operators.regression import least_squares, quadratic_variation, to_sd


def compare(df: DataFrame, equations: dict[str, Equation], target: str) -> DataFrame:
    """Rows (model, k, r_squared, adj_r_squared, rmse, aic, bic), best BIC first.

    All models' sums are columns of one aggregation of the data.
    """
    y, sums = F.col(target), []
    for i, e in enumerate(equations.values()):
        gap = y - e.column()
        sums.append(F.struct(F.count(gap).alias("n"), F.sum(gap * gap).alias("rss"), F.var_pop(F.when(gap.isNotNull(), y)).alias("v")).alias(f"s{i}"))
    each = [F.struct(F.lit(name).alias("model"), F.lit(max(1, len(e.coefficients))).alias("k"), F.col(f"s{i}").alias("s")) for i, (name, e) in enumerate(equations.items())]
    t = df.agg(*sums).select(F.inline(F.array(*each))).select("model", "k", "s.*")
    n, rss, k = F.col("n"), F.col("rss"), F.col("k")
    t = t.withColumn("r_squared", 1 - rss / F.nullif(n * F.col("v"), F.lit(0.0)))
    loglik = n * (F.ln(F.when(rss > 0, rss) / n) + moments.TWO_PI + 1)
    out = t.select("model", "k", "r_squared", (1 - (1 - F.col("r_squared")) * (n - 1) / F.nullif(n - k, F.lit(0))).alias("adj_r_squared"), F.sqrt(rss / n).alias("rmse"), (loglik + 2 * (k + 1)).alias("aic"), (loglik + F.ln(n) * (k + 1)).alias("bic"))
    return out.orderBy("bic", "model")


def qualitative_check(spark, equation: Equation, variable: str, low: float, high: float, stabilities: list[str] | None = None, n_fixed_points: int | None = None, bounded: bool | None = None) -> DataFrame:
    """Rows (check, expected, found, passed) for the number and pattern of fixed points, and boundedness.

    Dynamics are bounded on the range when they point inwards at both its ends.
    """
    points = dynamics.analyse_fixed_points(spark, equation, variable, low, high).agg(F.sort_array(F.collect_list(F.struct("fixed_point", "stability"))).alias("p"))
    ends = [equation.column({variable: F.lit(float(x))}) for x in (low, high)]
    s = points.select(F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["stability"]), ",").alias("pattern"), ((ends[0] > 0) & (ends[1] < 0)).cast("string").alias("inward"))
    rows = []
    if n_fixed_points is not None:
        rows.append(F.struct(F.lit("n_fixed_points").alias("check"), F.lit(str(n_fixed_points)).alias("expected"), F.col("n").cast("string").alias("found")))
    if stabilities is not None:
        rows.append(F.struct(F.lit("stability_pattern").alias("check"), F.lit(",".join(stabilities)).alias("expected"), F.col("pattern").alias("found")))
    if bounded is not None:
        rows.append(F.struct(F.lit("bounded").alias("check"), F.lit(str(bounded).lower()).alias("expected"), F.col("inward").alias("found")))
    return s.select(F.inline(F.array(*rows))).withColumn("passed", F.col("expected") == F.col("found"))


@dataclass
class StochasticModel:
    """dz = drift dt + diffusion dW for every series: coefficient tables of both, by key."""

    drift: DataFrame
    diffusion: DataFrame
    history: DataFrame


def stochastic_model(df: DataFrame, panel: Panel, target: str, predictors: list[str], iterations: int = 3) -> StochasticModel:
    """Drift by reweighted least squares, diffusion from the quadratic variation of the series.

    Each iteration models the residuals' absolute size on the predictors, weighs rows by its
    inverse square (mean one per series), and refits. Every iteration's weighted deviance under
    the last weights is kept, and the one of least deviance, the earliest among equals, is
    the drift. All series are fitted at once; an iteration is two aggregations,
    whose results (a row per series) are checkpointed.
    """
    keys = list(panel.keys)
    d = df.filter(F.col(target).isNotNull()).withColumn("_w", F.lit(1.0))
    fits, weighted = [], d
    terms = {p: F.col(p) for p in predictors}

    def fitted(rows: DataFrame, fit: DataFrame, out: str) -> DataFrame:
        small = fit.select(*keys, F.col("`(Intercept)`").alias("_a"), *[F.col(p).alias(f"_b_{p}") for p in predictors])
        value = F.col("_a")
        for p in predictors:
            value = value + F.col(f"_b_{p}") * F.col(p)
        return rows.join(small, keys).withColumn(out, value).drop("_a", *[f"_b_{p}" for p in predictors])

    for i in range(1, iterations + 1):
        fit = settled(least_squares(weighted, keys, F.col(target), terms, F.col("_w")))  # a row per series
        fits.append(fit.withColumn("iteration", F.lit(i)))
        left = fitted(d, fit, "_fit").withColumn("_r", F.col(target) - F.col("_fit"))
        size = settled(least_squares(left, keys, F.abs("_r"), terms))
        g = to_sd(F.col("_g"), "absolute")
        left = fitted(left, size, "_g").withColumn("_w", 1 / F.greatest(g * g, F.lit(1e-10)))
        weighted = left.withColumn("_w", F.col("_w") / F.avg("_w").over(panel.whole)).drop("_fit", "_r", "_g")
    scores = None
    for i, fit in enumerate(fits, 1):
        s = moments.weighted_deviance(fitted(weighted, fit, "_fit"), keys, target, "_fit", "_w").withColumn("iteration", F.lit(i))
        scores = s if scores is None else scores.unionByName(s)
    best = scores.groupBy(*keys).agg(F.min(F.struct("deviance", "iteration"))["iteration"].alias("iteration"))
    every = fits[0]
    for f in fits[1:]:
        every = every.unionByName(f)
    local = quadratic_variation(df, panel)
    return StochasticModel(every.join(best, [*keys, "iteration"]), least_squares(local, keys, F.col("diffusion"), terms), scores)


def validate_model(df: DataFrame, panel: Panel, equation: Equation, target: str, folds: int = 5, weight: str | None = None, method: str = "block", horizon: int = 1) -> dict[str, DataFrame]:
    """Cross-validation of an equation with refit, its fit statistics and residual tests, as DataFrames.

    ``method`` is block, random or rolling (test windows of ``horizon`` rows at the end).
    """
    keys = list(panel.keys)
    d = df.filter(F.col(target).isNotNull()).withColumn("_fit", equation.column()).withColumn("residual", F.col(target) - F.col("_fit"))
    if method == "rolling":
        scores = refit.cross_validate_equation(validation.rolling_folds(d, panel, folds, horizon), keys, equation, target, weight)
    else:
        numbered = {"block": validation.block_folds, "random": validation.random_folds}[method](d, panel, folds)
        scores = refit.cross_validate_folds(numbered, keys, equation, target, weight, folds)
    scores = settled(scores)
    from dataclasses import replace

    return {
        "folds": scores,
        "cross_validation": validation.cv_summary(scores, keys),
        "fit": moments.fit_statistics(d, keys, target, "_fit", max(1, len(equation.coefficients))),
        "residual_tests": moments.diagnostics(d, replace(panel, value="residual")),
    }


def phase_surface(df: DataFrame, x: str, y: str, equation: Equation, points: int = 30) -> DataFrame:
    """Rows (x, y, value): the equation over a grid that spans the data."""
    spark = df.sparkSession
    lo_x, hi_x, lo_y, hi_y = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    grid = dynamics.line(spark, lo_x, hi_x, points, x).crossJoin(F.broadcast(dynamics.line(spark, lo_y, hi_y, points, y)))  # points rows each
    return grid.withColumn("value", equation.column())
