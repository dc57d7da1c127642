"""Stochastic models dz = f dt + g dW of every series: the drift found by reweighted searches, chosen by cross-validation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equations import Equation
from ..operators import search
from ..operators.lineage import settled
from ..operators.panel import Panel, row_numbers
from ..operators.regression import least_squares, quadratic_variation, solve_centred
from ..shipping import shipped

#: Rows of one series that meet its state in one task; longer series are joined in parts.
PART = 200_000
#: Least variance of a residual, so that weights stay finite.
LEAST_VARIANCE = 1e-10

Library = tuple[dict[str, Column], list[tuple[int, list[str]]]]


@dataclass
class StochasticFit:
    """Models by key.

    ``drift``: keys, form, complexity, equation, beta (intercept, then one number a term of the
    library), n, n_iterations, converged, converged_at, stop_reason (converged, max_iter,
    non_finite), selected_iteration, score, rule. ``diffusion``: keys, n, g (intercept, then
    one number a predictor). ``history``: keys, iteration, form, equation, deviance,
    objective_change, iterate_change, and score under the last weights. Scores are of
    candidates that were found on the same rows: they rank, they are no error on new data.
    """

    drift: DataFrame
    diffusion: DataFrame
    history: DataFrame
    keys: list[str]
    predictors: list[str]
    terms: dict[str, Column]

    def predict(self, df: DataFrame, component: str = "both") -> DataFrame:
        """``df`` with columns drift, diffusion or both; rows of a series without a model are left out."""
        if component not in ("drift", "diffusion", "both"):
            raise ValueError(f"component is drift, diffusion or both, not {component}")
        out, names = df, list(df.columns)
        if component != "diffusion":
            out = out.join(self.drift.select(*self.keys, F.col("beta").alias("_beta")), self.keys).withColumn("drift", linear("_beta", list(self.terms.values())))
        if component != "drift":
            g = self.diffusion.select(*self.keys, F.col("g").alias("_g"))
            out = out.join(g, self.keys).withColumn("diffusion", F.greatest(linear("_g", [F.col(p) for p in self.predictors]), F.lit(0.0)))
        return out.select(*names, *(c for c in ("drift", "diffusion") if component in (c, "both")))


def linear(beta: str, terms: list[Column]) -> Column:
    """Intercept and terms times the numbers of an array column; a term whose number is zero is not looked at."""
    value = F.col(beta)[0]
    for i, t in enumerate(terms, 1):
        value = value + F.when(F.col(beta)[i] != 0, F.col(beta)[i] * t.cast("double")).otherwise(0.0)
    return value


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def with_state(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their series, under names with an underscore in front.

    A long series is met in parts of PART rows, so none is one task's.
    """
    parts = state.select(*keys, *[F.col(c).alias(f"_{c}") for c in state.columns if c not in keys])
    parts = parts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / PART))))
    return rows.join(parts, [*keys, "_part"])


def sums_about(rows: DataFrame, by: list[str], values: list[Column], w: Column, centre: str) -> DataFrame:
    """Per ``by``: rows, mass, and weighted sums ``a`` and products ``b`` (upper half, by rows) of the values less an array of centres."""
    e = [v - F.col(centre)[i] for i, v in enumerate(values)]
    first = F.array(*[F.sum(w * x) for x in e]).alias("a")
    second = F.array(*[F.sum(w * x * y) for i, x in enumerate(e) for y in e[i:]]).alias("b")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(w).alias("mass"), first, second)


def square_of(b: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = np.asarray(b, dtype=float)
    return out + np.triu(out, 1).T


def solve_form(centre: np.ndarray, mass: float, a: np.ndarray, b: np.ndarray, used: list[int], rows: int) -> tuple[np.ndarray, float, float] | None:
    """Numbers of the form with the terms ``used`` (1-based), its residual and total sum of squares; None where they are not determined."""
    at = [0, *used]
    if rows <= len(at) or not mass > 0:
        return None
    with np.errstate(all="ignore"):
        mean, s = centre[at] + a[at] / mass, b[np.ix_(at, at)] - np.outer(a[at], a[at]) / mass
        got = solve_centred(mean, s)
    if got is None:
        return None
    beta = np.zeros(len(centre))
    beta[at] = got[0]
    return beta, got[2], float(s[0, 0])


def pick(found: list[tuple[int, str, float]], n: int, criterion: str) -> int:
    """Index of the chosen (complexity, form, mse): knee of the front, BIC or AIC, min_error or min_complexity; ties to the simplest."""
    order = sorted(range(len(found)), key=lambda i: (found[i][0], found[i][2], found[i][1]))
    front: list[int] = []
    for i in order:
        if not front or found[i][2] < found[front[-1]][2]:
            front.append(i)
    c, e = np.array([found[i][0] for i in front], dtype=float), np.array([found[i][2] for i in front])
    if criterion == "knee":
        u, v = ((x - x.min()) / (x.max() - x.min() + 1e-10) for x in (c, e))
        du, dv = u[-1] - u[0], v[-1] - v[0]
        chord = np.hypot(du, dv)
        gap = np.abs(dv * u - du * v + u[-1] * v[0] - v[-1] * u[0]) / chord if chord > 0 else np.zeros(len(front))
        return front[int(np.argmax(np.round(gap, 12)))]
    with np.errstate(divide="ignore"):
        score = {"BIC": n * np.log(e) + c * np.log(n), "AIC": n * np.log(e) + 2 * c, "min_error": e, "min_complexity": c}[criterion]
    return front[int(np.argmin(score))]


def spelled(beta: np.ndarray, names: list[str]) -> str:
    return " + ".join([f"{beta[0]:.10g}", *(f"{b:.10g} * {t}" for b, t in zip(beta[1:], names, strict=True) if b != 0)])


def fit_stochastic(
    df: DataFrame,
    panel: Panel,
    target: str,
    predictors: list[str],
    library: Library | None = None,
    criterion: str = "knee",
    initial: Equation | None = None,
    max_iterations: int = 10,
    tolerance: float = 1e-4,
    selection: str = "blocked_cv",
    blocks: int = 5,
    diffusion: str = "quadratic_variation",
) -> StochasticFit:
    """Drift of every series by a search inside generalised least squares, and its diffusion.

    Starting from ``initial`` or an unweighted search, each iteration fits the residuals'
    absolute size as a line in the predictors, weighs rows by its inverse square, and
    searches all forms of ``library`` (``search.library`` of the predictors) again under these
    weights, choosing one by ``criterion``. A series stops when both its weighted deviance
    and its fitted values move by less than ``tolerance`` (relative); the others go on.
    Of its iterations the one is taken that scores best under the last weights: by cross-validation over
    ``blocks`` blocks in time, each form fitted again on the other blocks, or by deviance;
    where no block can be scored deviance decides (``rule``), and equals go to the earliest.

    An iteration is three aggregations with a row per series as result, for all series at
    once; cross-validation is one aggregation by series and block, whose sums give the fit
    of every candidate without every block. Rows with a null or NaN in target or predictors
    are left out. A series where no form can be fitted has its mean as drift (form ``1``);
    an empty table gives empty models. ``diffusion`` is quadratic_variation (of the panel's value,
    roots of rolling medians, as a line in the predictors) or residual (the last weights').
    """
    if selection not in ("blocked_cv", "deviance") or diffusion not in ("quadratic_variation", "residual"):
        raise ValueError("selection is blocked_cv or deviance, diffusion is quadratic_variation or residual")
    if max_iterations < 1 or blocks < 2:
        raise ValueError("at least one iteration and two blocks are needed")
    keys = list(panel.keys)
    terms, forms = library or search.library(predictors)
    names, places = list(terms), [[list(terms).index(u) + 1 for u in used] for _, used in forms]
    labels, x = [" + ".join(used) for _, used in forms], [F.col(p).cast("double") for p in predictors]
    width, k, values = len(x), len(names) + 1, [F.col("_y"), *(t.cast("double") for t in terms.values())]
    start = initial.column() if initial else F.lit(None).cast("double")

    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (target, *predictors)])
    kept = row_numbers(df.filter(whole).select(*dict.fromkeys([*keys, panel.time, *predictors]), F.col(target).cast("double").alias("_y"), start.alias("_start")), panel)
    block = F.least(F.lit(blocks), F.floor((F.col("rn") * blocks - 1) / F.col("n")) + 1).cast("int")
    kept = settled(kept.select(*dict.fromkeys([*keys, *predictors]), "_y", "_start", F.floor(F.col("rn") / PART).alias("_part"), block.alias("_block")))
    by_key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys).schema)

    def weights(g: str) -> Column:
        sd = F.greatest(linear(g, x), F.lit(0.0))
        return 1 / F.greatest(sd * sd, F.lit(LEAST_VARIANCE))

    def weighted(state: DataFrame, w: Column, by: list[str]) -> DataFrame:
        """Sums about the weighted means of a series, which come first, so that heavy rows cost no digits."""
        rows = with_state(kept, state, keys)
        means = rows.groupBy(*keys).agg(F.first("_n").alias("n"), F.array(*[F.sum(w * v) / F.sum(w) for v in values]).alias("centre"))
        at = state.drop("n", "centre").join(means, keys)
        sums = sums_about(with_state(kept, at, keys), by, values, w, "_centre")
        return sums.join(at, keys)

    def searched(sums: DataFrame, carried: list[str]) -> DataFrame:
        schema = ", ".join([by_key, "n long", "form string", "complexity int", "beta array<double>", *carried])
        extra = [c.split()[0] for c in carried]

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for r in b.to_dict("records"):
                    centre, a, products = np.array(r["centre"], dtype=float), np.array(r["a"], dtype=float), square_of(r["b"], k)
                    solved = []
                    for (complexity, _), label, used in zip(forms, labels, places, strict=True):
                        got = solve_form(centre, r["mass"], a, products, used, r["rows"])
                        if got is not None:
                            exact = got[1] < 1e-13 * got[2]
                            solved.append((complexity, label, 0.0 if exact else got[1] / r["mass"], got[0]))
                    row = {c: r[c] for c in [*keys, "n", *extra]}
                    if solved:
                        complexity, label, _, beta = solved[pick([s[:3] for s in solved], r["rows"], criterion)]
                    else:
                        complexity, label, beta = 0, "1", np.r_[centre[0] + a[0] / r["mass"], np.zeros(k - 1)]
                    out.append(row | {"form": label, "complexity": complexity, "beta": beta.tolist()})
                yield pd.DataFrame(out, columns=[*keys, "n", "form", "complexity", "beta", *extra])

        return shipped(sums.select(*keys, "n", "rows", "mass", "centre", "a", "b", *extra)).mapInPandas(best, schema)

    def sized(fit: Column) -> list[Column]:
        """Sums of the residuals' absolute size and the predictors; a residual that is not finite counts as zero."""
        size = F.abs(F.col("_y") - fit)
        columns = [F.when(finite(size), size).otherwise(0.0), *x]
        return [F.count(F.lit(1)).alias("rows"), F.array(*[F.avg(c) for c in columns]).alias("m"), F.array(*[F.covar_pop(c, e) for i, c in enumerate(columns) for e in columns[i:]]).alias("s")]

    def size_model(m: np.ndarray, s: np.ndarray, rows: int) -> list[float]:
        got = solve_centred(np.asarray(m, dtype=float), square_of(s, width + 1) * rows)
        return (got[0] if got is not None else np.r_[m[0], np.zeros(width)]).tolist()

    def first_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = [size_model(m, s, n) for m, s, n in zip(b["m"], b["s"], b["rows"], strict=True)]
            yield b[[*keys, "n"]].assign(next_g=g, beta=[None] * len(b), deviance=np.nan, failed=False)

    counts = settled(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    if initial:
        rows, fit = with_state(kept, counts, keys), F.col("_start")
    else:
        rows, fit = with_state(kept, settled(searched(weighted(counts, F.lit(1.0), keys), [])), keys), linear("_beta", values[1:])
    state_schema = f"{by_key}, n long, next_g array<double>, beta array<double>, deviance double, failed boolean"
    state = settled(shipped(rows.groupBy(*keys).agg(F.first("_n").alias("n"), *sized(fit))).mapInPandas(first_sizes, state_schema))

    def judge(i: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                number = {c: np.nan if r[c] is None else float(r[c]) for c in ("loss", "moved", "scale", "old_deviance")}
                # Without an iteration before, or with one that was not finite, there is nothing to compare.
                objective = abs(number["loss"] - number["old_deviance"]) / (abs(number["old_deviance"]) + 1e-12)
                iterate = np.sqrt(number["moved"]) / (np.sqrt(number["scale"]) + 1e-12)
                known = bool(np.isfinite(objective) and np.isfinite(iterate))
                done = known and objective < tolerance and iterate < tolerance
                failed = bool(r["failed"]) or (i > 1 and not known)
                reason = "converged" if done else "non_finite" if failed else "max_iter"
                row = {c: r[c] for c in [*keys, "n", "form", "complexity", "g"]} | {"beta": list(r["beta"]), "next_g": size_model(r["m"], r["s"], r["rows"])}
                out.append(row | {"iteration": i, "equation": spelled(np.asarray(r["beta"], dtype=float), names), "deviance": number["loss"], "objective_change": objective, "iterate_change": iterate, "failed": failed, "stop_reason": reason, "done": done})
            yield pd.DataFrame(out, columns=[*keys, "n", "form", "complexity", "g", "beta", "next_g", "iteration", "equation", "deviance", "objective_change", "iterate_change", "failed", "stop_reason", "done"])

    judged = f"{by_key}, n long, form string, complexity int, g array<double>, beta array<double>, next_g array<double>, iteration int, equation string, deviance double, objective_change double, iterate_change double, failed boolean, stop_reason string, done boolean"
    tried = []
    for i in range(1, max_iterations + 1):
        given = state.select(*keys, "n", F.col("next_g").alias("g"), F.col("beta").alias("old"), F.col("deviance").alias("old_deviance"), "failed")
        new = settled(searched(weighted(given, weights("_g"), keys), ["g array<double>", "old array<double>", "old_deviance double", "failed boolean"]))
        w, now, then = weights("_g"), linear("_beta", values[1:]), linear("_old", values[1:])
        gap, move, ok = F.col("_y") - now, now - then, finite(now)
        both = ok & finite(then)
        measures = [
            (F.sum(F.when(ok, w * gap * gap)) / F.sum(F.when(ok, w))).alias("loss"),
            (F.sum(F.when(both, w * move * move)) / F.sum(F.when(both, w))).alias("moved"),
            (F.sum(F.when(both, w * then * then)) / F.sum(F.when(both, w))).alias("scale"),
        ]
        seen = with_state(kept, new, keys).groupBy(*keys).agg(*measures, *sized(now)).join(new, keys)
        state = settled(shipped(seen).mapInPandas(lambda batches, i=i: judge(i, batches), judged))
        tried.append(state)
        state = state.filter("not done")
        if i < max_iterations and state.isEmpty():
            break
    every = reduce(DataFrame.unionByName, tried)

    # The last weights of each series, and all its iterations, a few rows, beside the sums of its blocks.
    last = settled(every.groupBy(*keys).agg(F.max_by(F.struct("n", "g", "stop_reason", "done"), "iteration").alias("l"), F.max("iteration").alias("n_iterations")).select(*keys, "l.*", "n_iterations"))
    sums = weighted(last.select(*keys, "n", "g"), weights("_g"), [*keys, "_block"])
    per_series = sums.groupBy(*keys).agg(F.first("centre").alias("centre"), F.sort_array(F.collect_list(F.struct("_block", "rows", "mass", "a", "b"))).alias("parts"))
    candidates = every.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("iteration", "form", "beta"))).alias("tried"))
    used_by = dict(zip(labels, places, strict=True)) | {"1": []}

    def loss(part: dict, centre: np.ndarray, beta: np.ndarray) -> float:
        """Weighted squared residuals of a block from its sums: what its mean leaves, and what is left about the mean."""
        use = np.flatnonzero(beta[1:]) + 1
        at, mass = [0, *use], float(part["mass"])
        a, b = np.asarray(part["a"], dtype=float)[at], square_of(part["b"], k)[np.ix_(at, at)]
        mean, s, c = centre[at] + a / mass, b - np.outer(a, a) / mass, np.r_[1.0, -beta[use]]
        return mass * (c @ mean - beta[0]) ** 2 + max(float(c @ s @ c), 0.0)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                centre, parts = np.asarray(r["centre"], dtype=float), [p if isinstance(p, dict) else p.asDict() for p in r["parts"]]
                judges = [p for p in parts if p["rows"] >= 2]
                for t in r["tried"]:
                    t = t if isinstance(t, dict) else t.asDict()
                    beta, total, mass = np.asarray(t["beta"], dtype=float), 0.0, 0.0
                    whole = sum(loss(p, centre, beta) for p in parts) / sum(p["mass"] for p in parts)
                    for p in judges:
                        rest = [o for o in parts if o["_block"] != p["_block"]]
                        refit = None
                        if rest:
                            a, products = sum(np.asarray(o["a"], dtype=float) for o in rest), sum(square_of(o["b"], k) for o in rest)
                            refit = solve_form(centre, sum(o["mass"] for o in rest), a, products, used_by[t["form"]], sum(o["rows"] for o in rest))
                        total, mass = total + loss(p, centre, refit[0] if refit else beta), mass + p["mass"]
                    out.append({c: r[c] for c in keys} | {"iteration": t["iteration"], "cv": total / mass if mass else np.nan, "final_deviance": whole})
            yield pd.DataFrame(out, columns=[*keys, "iteration", "cv", "final_deviance"])

    scores = shipped(per_series.join(candidates, keys)).mapInPandas(scored, f"{by_key}, iteration int, cv double, final_deviance double")
    asked = F.col("cv" if selection == "blocked_cv" else "final_deviance")
    history = settled(every.join(scores, [*keys, "iteration"]).withColumn("score", F.when(finite(asked), asked)))
    usable = F.coalesce(F.col("score"), F.lit(float("inf")))
    fallback = F.when(finite(F.col("final_deviance")), F.col("final_deviance")).otherwise(float("inf"))
    chosen = history.groupBy(*keys).agg(F.min(F.struct(usable.alias("s"), F.when(F.col("score").isNull(), fallback).otherwise(0.0).alias("f"), "iteration", "form", "complexity", "equation", "beta", "score")).alias("x"))
    rule = F.when(F.col("x.score").isNotNull(), selection).when(F.col("x.f") < float("inf"), "deviance_fallback").otherwise("all_non_finite")
    chosen = chosen.select(*keys, "x.form", "x.complexity", "x.equation", "x.beta", F.col("x.iteration").alias("selected_iteration"), "x.score", rule.alias("rule"))
    drift = chosen.join(last.select(*keys, "n", "n_iterations", F.col("done").alias("converged"), F.when(F.col("done"), F.col("n_iterations")).alias("converged_at"), "stop_reason"), keys)
    if diffusion == "residual":
        spread = last.select(*keys, "n", "g")
    else:
        local = least_squares(quadratic_variation(df, panel), keys, F.col("diffusion"), dict(zip(predictors, x, strict=True)))
        spread = local.select(*keys, "n", F.array("`(Intercept)`", *[F.col(f"`{p}`") for p in predictors]).alias("g"))
    shown = history.select(*keys, "iteration", "form", "equation", "deviance", *[F.when(finite(F.col(c)), F.col(c)).alias(c) for c in ("objective_change", "iterate_change")], "score")
    return StochasticFit(drift, spread, shown, keys, predictors, terms)
