"""Generalised linear models for many groups at once, by iteratively reweighted least squares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..shipping import shipped
from .bounded import meeting
from .lineage import settled
from .refit import with_roles

Of = Callable[[Column], Column]


@dataclass(frozen=True)
class Link:
    forward: Of
    back: Of
    slope: Of  # of ``back``, at eta


@dataclass(frozen=True)
class Family:
    variance: Of
    deviance: Callable[[Column, Column], Column]  # of one row, at its mean
    start: Of
    link: str
    dispersed: bool


def _ylogy(y: Column, mu: Column) -> Column:
    return F.when(y == 0, F.lit(0.0)).otherwise(y * F.ln(F.try_divide(y, mu)))


LINKS = {
    "identity": Link(lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "log": Link(F.ln, F.exp, F.exp),
    "inverse": Link(lambda m: F.try_divide(F.lit(1.0), m), lambda e: F.try_divide(F.lit(1.0), e), lambda e: F.try_divide(F.lit(-1.0), e * e)),
    "sqrt": Link(F.sqrt, lambda e: e * e, lambda e: 2 * e),
    "logit": Link(lambda m: F.ln(F.try_divide(m, 1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda e: 1 / (2 + F.exp(e) + F.exp(-e))),
}
FAMILIES = {
    "gaussian": Family(lambda m: F.lit(1.0), lambda y, m: (y - m) * (y - m), lambda y: y, "identity", True),
    "poisson": Family(lambda m: m, lambda y, m: 2 * (_ylogy(y, m) - (y - m)), lambda y: y + 0.1, "log", False),
    "binomial": Family(lambda m: m * (1 - m), lambda y, m: 2 * (_ylogy(y, m) + _ylogy(1 - y, 1 - m)), lambda y: (y + 0.5) / 2, "logit", False),
    "gamma": Family(lambda m: m * m, lambda y, m: -2 * (F.ln(F.try_divide(y, m)) - F.try_divide(y - m, m)), lambda y: y, "inverse", True),
}


def glm(df: DataFrame, keys: list[str], target: str, terms: dict[str, Column], family: str = "gaussian", link: str | None = None, weight: Column | None = None, rounds: int = 50, tolerance: float = 1e-12, times: Column | None = None) -> DataFrame:
    """Rows (keys, n, coefficients, se_<name>, deviance, null_deviance, dispersion, rounds, converged): one model per key.

    Each round is one aggregation of weighted products at every group's coefficients, and a
    small solve per group; predictors are standardised by group first. A step to where the
    mean is not defined is halved. Families: gaussian, poisson, binomial (a 0/1 or share
    target), gamma; links: identity, log, logit, inverse, sqrt, the family's own unless
    given. ``times`` says how many equal rows a row stands for. Rows with a null are left out. Groups whose terms are dependent, or whose target is
    impossible for the family, have null coefficients.
    """
    fam, lnk = FAMILIES[family], LINKS[link or FAMILIES[family].link]
    names, k = list(terms), len(terms) + 1
    y = F.col(target).cast("double")
    count = F.lit(1).cast("long") if times is None else times.cast("long")
    rows = df.select(*keys, y.alias("_y"), ((F.lit(1.0) if weight is None else weight.cast("double")) * count).alias("_w"), count.alias("_t"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(terms.values())])
    rows = rows.dropna(subset=[c for c in rows.columns if c not in keys])
    about = rows.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("_y")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_mean"), *[c for i in range(k - 1) for c in (F.avg(f"_x{i}").alias(f"_m{i}"), F.coalesce(F.nullif(F.stddev_pop(f"_x{i}"), F.lit(0.0)), F.lit(1.0)).alias(f"_d{i}"))])
    about = settled(about)
    groups = about.count()
    rows = meeting(rows, about, keys, groups).select(*keys, "_y", "_w", "_t", "_mean", *[((F.col(f"_x{i}") - F.col(f"_m{i}")) / F.col(f"_d{i}")).alias(f"_z{i}") for i in range(k - 1)]).persist(StorageLevel.MEMORY_AND_DISK)

    z = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(k - 1)]]
    w, y = F.col("_w"), F.col("_y")
    begun = F.size("trial") > 0
    eta = lnk.forward(fam.start(y))
    linear = F.get("trial", F.lit(0))
    for i in range(1, k):
        linear = linear + F.get("trial", F.lit(i)) * z[i]
    eta = F.when(begun, linear).otherwise(eta)
    mu, slope = lnk.back(F.col("_eta")), lnk.slope(F.col("_eta"))
    held = F.col("_mu")
    work, heavy = F.col("_eta") + F.try_divide(y - held, F.col("_slope")), F.try_divide(w * F.col("_slope") * F.col("_slope"), fam.variance(held))
    sums = [F.sum(heavy * z[i] * z[j]) for i in range(k) for j in range(k)] + [F.sum(heavy * z[i] * work) for i in range(k)]
    unit = fam.deviance(y, held)
    # A row whose mean the family does not know spoils the sums of its group, rather than drop out of them.
    every = F.count(F.when(work.isNotNull() & heavy.isNotNull(), 1)) == F.count(y)
    sums = [F.array(*[F.when(every, c) for c in sums]).alias("now"), F.when(F.count(unit) == F.count(y), F.sum(w * unit)).alias("found"), F.sum(w * fam.deviance(y, F.col("_mean"))).alias("none"), F.sum(F.try_divide(w * (y - held) * (y - held), fam.variance(held))).alias("_chi"), F.sum("_t").alias("rows")]
    doubles = ArrayType(DoubleType())
    fields = [StructField("trial", doubles), StructField("best", doubles), StructField("sums", doubles)] + [StructField(c, DoubleType()) for c in ("loss", "null_deviance", "chi")] + [StructField("n", LongType()), StructField("rounds", IntegerType()), StructField("halved", IntegerType()), StructField("done", BooleanType()), StructField("good", BooleanType())]

    def step(r: dict) -> dict:
        now = np.array([np.nan if v is None else v for v in r["now"]], dtype=float)
        found = np.nan if r["found"] is None else float(r["found"])
        trial, best, known = (np.array(r[c], dtype=float) for c in ("trial", "best", "sums"))
        out = {"null_deviance": r["none"], "n": r["rows"], "rounds": r["rounds"] + 1, "halved": 0, "chi": r["_chi"], "loss": found}
        bad = not np.isfinite(now).all() or (len(trial) and not np.isfinite(found))
        if bad:
            if len(best) and r["halved"] < 30:
                return out | {"trial": (trial + best) / 2, "best": best, "sums": known, "loss": r["loss"], "chi": r["chi"], "halved": r["halved"] + 1, "done": False, "good": False}
            return out | {"trial": [], "best": [], "sums": [], "done": True, "good": False}
        xx, xy = now[: k * k].reshape(k, k), now[k * k :]
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        ok = np.linalg.eigvalsh(xx / scale[:, None] / scale)[0] > 1e-12
        if not ok:
            return out | {"trial": [], "best": [], "sums": [], "done": True, "good": False}
        over = len(trial) > 0 and abs(found - r["loss"]) <= tolerance * (abs(found) + 0.1)
        if over:
            return out | {"trial": trial, "best": trial, "sums": now, "done": True, "good": True}
        new = np.linalg.solve(xx / scale[:, None] / scale, xy / scale) / scale
        return out | {"trial": new, "best": trial if len(trial) else [], "sums": now, "done": False, "good": False}

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{c: r[c] for c in keys} | step(r) for r in b.to_dict("records")], columns=[*keys, *(f.name for f in fields)])

    of_keys = [f for f in rows.schema.fields if f.name in keys]
    none = F.array().cast(doubles)
    state = settled(about.select(*keys, none.alias("trial"), none.alias("best"), none.alias("sums"), *[F.lit(float("inf")).alias(c) for c in ("loss", "null_deviance", "chi")], F.lit(0).cast("long").alias("n"), F.lit(0).alias("rounds"), F.lit(0).alias("halved"), F.lit(False).alias("done"), F.lit(False).alias("good")))
    finished = []
    for _ in range(rounds):
        left = state.count()
        if not left:
            break
        at = meeting(rows, state.select(*keys, "trial"), keys, left).withColumn("_eta", eta).withColumns({"_mu": mu, "_slope": slope})
        got = at.groupBy(*keys).agg(*sums)
        known = state.join(got, keys) if keys else state.crossJoin(F.broadcast(got))
        state = settled(shipped(known).mapInPandas(advance, StructType([*of_keys, *fields])))
        finished.append(state.filter("done"))
        state = state.filter("not done")
    for f in finished:
        state = state.unionByName(f)
    rows.unpersist()

    label, dispersed = ["(Intercept)", *names], fam.dispersed

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                row = {c: r[c] for c in keys} | {"n": r["n"], "deviance": r["loss"] if r["good"] else None, "null_deviance": r["null_deviance"] if r["good"] else None, "rounds": r["rounds"], "converged": bool(r["good"])}
                spread = (r["chi"] / (r["n"] - k) if r["n"] > k else None) if dispersed else 1.0
                row["dispersion"] = spread if r["good"] else None
                beta, se = [None] * k, [None] * k
                if r["good"]:
                    turn = np.eye(k)  # from standardised predictors to the given ones
                    for i in range(1, k):
                        turn[i, i] = 1 / r[f"_d{i - 1}"]
                        turn[0, i] = -r[f"_m{i - 1}"] / r[f"_d{i - 1}"]
                    beta = (turn @ np.array(r["best"], dtype=float)).tolist()
                    if spread is not None:
                        cov = turn @ np.linalg.inv(np.array(r["sums"], dtype=float)[: k * k].reshape(k, k)) @ turn.T
                        se = np.sqrt(np.maximum(np.diag(cov), 0) * spread).tolist()
                out.append(row | {m: v for m, v in zip(label, beta, strict=True)} | {f"se_{m}": v for m, v in zip(label, se, strict=True)})
            yield pd.DataFrame(out, columns=[f.name for f in final.fields])

    final = StructType([*of_keys, StructField("n", LongType()), *[StructField(c, DoubleType()) for m in label for c in (m, f"se_{m}")], *[StructField(c, DoubleType()) for c in ("deviance", "null_deviance", "dispersion")], StructField("rounds", IntegerType()), StructField("converged", BooleanType())])
    with_about = state.join(about, keys) if keys else state.crossJoin(F.broadcast(about))
    return shipped(with_about).mapInPandas(told, final)


def predict_glm(df: DataFrame, fit: DataFrame, keys: list[str], terms: dict[str, Column], family: str = "gaussian", link: str | None = None, out: str = "prediction", scale: str = "response") -> DataFrame:
    """``df`` with the model's prediction, on the scale of the response or of the link; null without a fit."""
    value = F.col("_c0")
    for i, c in enumerate(terms.values(), 1):
        value = value + F.col(f"_c{i}") * c.cast("double")
    if scale == "response":
        value = LINKS[link or FAMILIES[family].link].back(value)
    small = fit.select(*keys, *[F.col(f"`{m}`").alias(f"_c{i}") for i, m in enumerate(["(Intercept)", *terms])])
    met = df.join(small, keys, "left") if keys else df.crossJoin(F.broadcast(small))
    return met.withColumn(out, value).drop(*[f"_c{i}" for i in range(len(terms) + 1)])


def cross_validate_glm(df: DataFrame, keys: list[str], target: str, terms: dict[str, Column], family: str = "gaussian", link: str | None = None, weight: Column | None = None, folds: int = 5, fold: str = "fold") -> DataFrame:
    """Per key and fold of ``df`` (fold 1..``folds``): scores, on the response scale, of the model refitted on the other folds.

    Returns keys, fold, n_test, rmse, mae, ss_res, ss_tot (about the mean of the training
    rows), r_squared, deviance (mean of the family's), refitted. A fold whose model does not
    converge is scored by the mean of its training rows and not refitted.
    """
    y, by = F.col("_target"), [*keys, "fold"]
    named = {f"_term{i}": c.cast("double") for i, c in enumerate(terms.values())}
    rows = df.select(*keys, F.col(fold).alias("fold"), F.col(target).cast("double").alias("_target"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_weight"), *[c.alias(n) for n, c in named.items()])
    # Equal rows become one that counts for all, where that halves them at least; else each is copied once a fold.
    n, kinds = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*rows.columns))).first()
    rows = settled(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times"))) if kinds <= n / 2 else rows.withColumn("_times", F.lit(1).cast("long"))
    terms = {m: F.col(c) for m, c in zip(terms, named, strict=True)}
    roles = with_roles(rows, folds)
    train, test = roles.filter("role = 'train'"), roles.filter("role = 'test'")
    times = F.col("_times")
    fits = glm(train, by, "_target", terms, family, link, F.col("_weight"), times=times)
    means = train.groupBy(*by).agg((F.sum(F.col("_weight") * times * y) / F.sum(F.col("_weight") * times)).alias("_mean"))
    scored = predict_glm(test.join(means, by), fits.filter("converged"), by, terms, family, link, "_p")
    guess = F.coalesce("_p", "_mean")
    e, d, unit = y - guess, y - F.col("_mean"), FAMILIES[family].deviance(y, guess)
    total = lambda c: F.sum(times * c)
    mean = lambda c: F.sum(times * c) / F.sum(F.when(c.isNotNull(), times))
    s = scored.groupBy(*by).agg(F.coalesce(F.sum(F.when(y.isNotNull(), times)), F.lit(0)).alias("n_test"), F.sqrt(mean(e * e)).alias("rmse"), mean(F.abs(e)).alias("mae"), total(e * e).alias("ss_res"), total(d * d).alias("ss_tot"), mean(unit).alias("deviance"), F.bool_and(F.col("_p").isNotNull()).alias("refitted"))
    return s.withColumn("r_squared", 1 - F.col("ss_res") / F.nullif(F.col("ss_tot"), F.lit(0.0)))
