"""Exploring a target: transformations, phase portraits, tertiles and interactions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from ..functions import tails
from ..functions.equations import Equation
from ..operators import moments, windows
from ..operators.panel import Panel
from ..operators.regression import centred_moments, least_squares, moment_arrays, solve_centred
from ..shipping import shipped


def transformations(df: DataFrame, variables: list[str]) -> DataFrame:
    """Add log_, sqrt_ and sq_ columns of the variables that exist."""
    out = {}
    for v in variables:
        if v in df.columns:
            c = F.col(v)
            out |= {f"log_{v}": F.ln(F.abs(c) + 1e-10), f"sqrt_{v}": F.sqrt(F.abs(c)), f"sq_{v}": c * c}
    return df.withColumns(out)


def summands(text: str) -> list[str]:
    """The terms of a sum, split at the plus signs outside of parentheses."""
    terms, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "+" and depth == 0 and terms[-1].strip() and terms[-1].strip()[-1] not in "*/^(+-" and not re.search(r"\d[eE]$", terms[-1]):
            terms.append("")
        else:
            terms[-1] += c
    return [t.strip() for t in terms]


def formulas(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """Add a column for each named formula; one with several terms gives name_1, name_2, ..."""
    for name, text in named.items():
        terms = summands(text.lstrip("~ "))
        for i, t in enumerate(terms, 1):
            e = Equation(t)
            if not e.free(df.columns):
                df = df.withColumn(name if len(terms) == 1 else f"{name}_{i}", e.column())
    return df


#: Residual sums below this share of the total are rounding: the fit is exact, and simpler exact forms come first.
EXACT = 1e-13
FORMS = ("linear", "quadratic", "cubic")


def phase(df: DataFrame, keys: list[str], target: str, x: str) -> DataFrame:
    """Line, parabola and cubic of ``target`` in ``x`` per key: the published fits of a phase portrait.

    Returns keys, correlation, low and high (the range of x), for each form its AIC and its
    coefficients by power of x (an array; null where the powers are not independent),
    intercept and slope of the line, and the form of least AIC. Powers are of x less its
    mean over its spread, so a far origin costs no digits; the coefficients are
    turned back to powers of x itself. All forms share one aggregation.
    """
    d = df.filter(F.col(target).isNotNull() & F.col(x).isNotNull())
    c = F.col(x).cast("double")
    about = d.groupBy(*keys).agg(F.try_divide(F.covar_pop(x, target), F.stddev_pop(x) * F.stddev_pop(target)).alias("correlation"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(c).alias("_mean"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("_sd"))
    u = (c - F.col("_mean")) / F.col("_sd")
    unit = d.join(about.select(*keys, "_mean", "_sd"), keys) if keys else d.crossJoin(F.broadcast(about.select("_mean", "_sd")))
    m = centred_moments(unit, keys, [F.col(target), u, u * u, u * u * u])
    m = m.join(about, keys) if keys else m.crossJoin(F.broadcast(about))
    made = [f"{w}_{f}" for f in FORMS for w in ("aic", "coefficients")]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means, sums = moment_arrays(b, 4)
            found: dict[str, list] = {name: [None] * len(b) for name in made}
            for g in range(len(b)):
                n, centre, spread = int(b["n"].iloc[g]), float(b["_mean"].iloc[g]), float(b["_sd"].iloc[g])
                for k, form in enumerate(FORMS, 1):
                    got = solve_centred(means[g, : k + 1], sums[g, : k + 1, : k + 1]) if n else None
                    if got is None:
                        continue
                    beta, _, rss = got
                    rss = max(rss, EXACT * sums[g, 0, 0])
                    if rss > 0:
                        found[f"aic_{form}"][g] = n * math.log(rss / n) + n * math.log(2 * math.pi) + n + 2 * (k + 2)
                    raw = np.polynomial.Polynomial(beta)(np.polynomial.Polynomial([-centre / spread, 1 / spread])).coef
                    found[f"coefficients_{form}"][g] = [float(v) for v in np.r_[raw, np.zeros(k + 1 - len(raw))]]
            yield b[[*keys, "n", "correlation", "low", "high"]].assign(**found)

    schema = m.select(*keys, "n", "correlation", "low", "high").schema
    for name in made:
        schema = schema.add(StructField(name, DoubleType() if name.startswith("aic") else ArrayType(DoubleType())))
    out = shipped(m).mapInPandas(solve, schema)
    aics = [F.when(F.col(f"aic_{f}").isNotNull() & ~F.isnan(f"aic_{f}"), F.col(f"aic_{f}")) for f in FORMS]
    out = out.withColumns({f"aic_{f}": a for f, a in zip(FORMS, aics, strict=True)})
    best, form = F.least(*[F.col(f"aic_{f}") for f in FORMS]), F.lit(None).cast("string")
    for f in reversed(FORMS):
        form = F.when(F.col(f"aic_{f}") <= best, f).otherwise(form)
    line = F.col("coefficients_linear")
    return out.withColumns({"form": form, "intercept": F.get(line, F.lit(0)), "slope": F.get(line, F.lit(1))})


def tertile_slopes(df: DataFrame, keys: list[str], target: str, x: str) -> DataFrame:
    """Rows (keys, bin, n, slope): lines within thirds of ``x`` by its quantiles, or of its range where those tie.

    A slope needs more than five rows and some spread.
    """
    q = F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3)))
    cuts = df.groupBy(*keys).agg(q.alias("_q"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    tie = (F.col("_q")[0] == F.col("_q")[1]) | (F.col("_q")[0] == F.col("_lo")) | (F.col("_q")[1] == F.col("_hi"))
    third = (F.col("_hi") - F.col("_lo")) / 3
    cuts = cuts.select(*keys, F.when(tie, F.col("_lo") + third).otherwise(F.col("_q")[0]).alias("_a"), F.when(tie, F.col("_lo") + 2 * third).otherwise(F.col("_q")[1]).alias("_b"))
    d = df.join(cuts, keys).withColumn("bin", F.when(F.col(x) <= F.col("_a"), 1).when(F.col(x) <= F.col("_b"), 2).otherwise(3))
    return d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) > 5) & (F.stddev_samp(x) > 0), F.regr_slope(F.col(target).cast("double"), F.col(x).cast("double"))).alias("slope"))


def tertile_verdicts(slopes: DataFrame, keys: list[str]) -> DataFrame:
    """What three slopes in a row suggest: saturation when they fall from above zero, exponential growth when they rise to above zero."""
    s = slopes.groupBy(*keys).pivot("bin", [1, 2, 3]).agg(F.first("slope"))
    a, b, c = F.col("1"), F.col("2"), F.col("3")
    return s.select(*keys, F.when((a > b) & (b > c) & (a > 0), "Logistic saturation").when((a < b) & (b < c) & (c > 0), "Exponential").alias("suggestion"))


def interaction(df: DataFrame, keys: list[str], target: str, a: str, b: str) -> DataFrame:
    """F test of the product of two predictors beyond their sum."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sums = least_squares(df, keys, F.col(target), {a: x, b: y}).select(*keys, F.col("rss").alias("rss0"))
    full = least_squares(df, keys, F.col(target), {a: x, b: y, "ab": x * y}).select(*keys, "n", "rss")
    f = (F.col("rss0") - F.col("rss")) / (F.col("rss") / (F.col("n") - 4))
    both = full.join(sums, keys).withColumn("statistic", f)
    return both.select(*keys, "statistic", tails.f_upper_tail(F.col("statistic"), F.lit(1.0), (F.col("n") - 4).cast("double")).alias("p_value"))


def explore_dynamics(df: DataFrame, panel: Panel, target: str, predictors: list[str]) -> dict[str, DataFrame]:
    """The blocks of an exploration as DataFrames: time series, phase, tertiles and interactions."""
    keys = list(panel.keys)
    out = {"timeseries": moments.target_summary(df, panel), "change_points": windows.change_points(df, panel)}
    for p in predictors:
        out[f"phase_{p}"] = phase(df, keys, target, p)
        out[f"bivariate_{p}"] = tertile_verdicts(tertile_slopes(df, keys, target, p), keys)
    for i, p in enumerate(predictors):
        for q in predictors[i + 1 :]:
            out[f"interaction_{p}_{q}"] = interaction(df, keys, target, p, q)
    return out
