"""Nonlinear least squares for many groups at once, and cross-validation of an equation that is refitted.

Groups of up to MOST_LOCAL rows are dealt to tasks, PART rows or so at a time, where all rounds of
their fits run together. For longer groups every round is one aggregation of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.equations import Equation
from ..shipping import shipped
from .bounded import MOST_LOCAL, PART, Arrays, Rows, meeting
from .lineage import settled
from .panel import Panel, row_numbers


def stepped(s: Arrays, k: int, tolerance: float) -> Arrays:
    """The states of many fits after a round: ``now`` and ``found`` are the sums and the loss at ``trial``.

    A trial that is no better raises its fit's damping. A fit whose sums have never been finite ends.
    """
    now, found, best = s["now"], s["found"], s["best"]
    better = np.isfinite(found) & np.isfinite(now).all(axis=1) & ~(found > best)
    same = np.isfinite(best) & (best - found <= tolerance * (np.abs(best) + 1e-300))
    values, sums = np.where(better[:, None], s["trial"], s["values"]), np.where(better[:, None], now, s["sums"])
    has = np.isfinite(sums).all(axis=1)
    damping = np.where(better, np.maximum(s["damping"] / 10, 1e-12), s["damping"] * 100)
    over = np.where(better, same, damping > 1e12)
    jj, g = sums[:, : k * k].reshape(-1, k, k), sums[:, k * k :]
    steep = np.maximum(np.diagonal(jj, axis1=1, axis2=2), 1e-12)
    unit = jj + damping[:, None, None] * steep[:, :, None] * np.eye(k)
    sound = has & np.isfinite(unit).all(axis=(1, 2))
    unit = np.where(sound[:, None, None], unit, 0.0)
    trial = values + (np.linalg.pinv(unit, rcond=k * np.finfo(float).eps) @ np.where(sound[:, None], g, 0.0)[:, :, None])[:, :, 0]
    over = over | (np.abs(trial - values).max(axis=1) <= 1e-12 * (1 + np.abs(values).max(axis=1)))
    return {"values": values, "trial": trial, "best": np.where(better, found, best), "damping": damping, "sums": sums, "done": over | ~has, "converged": over & has}


def descended(rows: Rows, equation: Equation, start: dict[str, float], rounds: int, tolerance: float) -> Arrays:
    """Values, loss (infinite if never finite) and convergence of the fits of all groups of a task."""
    names, k, groups = list(start), len(start), rows.groups
    own = Equation(equation.text, {m: v for m, v in equation.coefficients.items() if m not in start})
    first = np.tile(np.array(list(start.values()), dtype=float), (groups, 1))
    state = {"values": first, "trial": first, "best": np.full(groups, np.inf), "damping": np.full(groups, 1e-6), "sums": np.full((groups, k * k + k), np.nan), "converged": np.zeros(groups, bool)}
    out, left = {c: state[c].copy() for c in ("values", "best", "converged")}, np.arange(groups)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            v, slopes = [state["trial"][rows.group, i] for i in range(k)], []
            at = lambda v: own.values({**rows.data, **dict(zip(names, v, strict=True))})  # noqa: E731, B023
            for i in range(k):
                h = np.maximum(np.abs(v[i]), 1e-3) * 1e-6
                slopes.append((at([*v[:i], v[i] + h, *v[i + 1 :]]) - at([*v[:i], v[i] - h, *v[i + 1 :]])) / (2 * h))
            gap = rows.y - at(v)
            pairs = {(i, j): rows.total(rows.w * slopes[i] * slopes[j]) for i in range(k) for j in range(i, k)}
            now = np.stack([*(pairs[min(i, j), max(i, j)] for i in range(k) for j in range(k)), *(rows.total(rows.w * d * gap) for d in slopes)], axis=1)
            found = np.where(rows.n > 0, rows.total(rows.w * gap * gap), np.nan)  # no sum without rows
            state = stepped({**state, "now": now, "found": found}, k, tolerance)
            for c, x in out.items():
                x[left] = state[c]
            going = ~state.pop("done")
            if not going.any():
                break
            if not going.all():
                rows, left, state = rows.of(going), left[going], {c: x[going] for c, x in state.items()}
    return out


def apart(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Rows of groups that are fitted inside tasks, rows of longer ones (None: there are none), and the number of parts of the first.

    A group with a null among its keys has no fit.
    """
    if not keys:
        return None, df, 0
    df = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys]))
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    small = F.col("_size") <= MOST_LOCAL
    local, long = sized.agg(F.coalesce(F.sum(F.when(small, F.col("_size"))), F.lit(0)), F.count_if(~small)).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-local // PART), min(2 * cores, local // 2000))
    if not long:
        return df, None, parts
    far = F.broadcast(settled(sized.filter(~small).select(*keys)))  # rows / MOST_LOCAL at most
    return df.join(far, keys, "left_anti"), df.join(far, keys, "left_semi"), parts


def in_tasks(df: DataFrame, keys: list[str], parts: int, equation: Equation, names: list[str], target: str, weight: str | None, others: list[Column], fields: list[StructField], work: Callable[[pa.Table, np.ndarray, np.ndarray, TaskRows], pa.Table]) -> DataFrame:
    """``work`` on whole groups of ``df``, in ``parts`` parts: it gets the table of keys and ``others``, each row's group, each group's first row, and the rows."""
    used = [c for c in equation.names() if c not in names and c not in equation.coefficients]
    y, w = F.col(target).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("_part"), *keys, *others, *[F.col(c).cast("double").alias(f"_u{i}") for i, c in enumerate(used)], y.alias("_y"), w.alias("_w"))
    # By a number of partitions: few bytes can be much work, which adaptive execution would put into one task.
    rows = rows.repartition(min(parts, 2000), "_part")

    def run(table: pa.Table) -> pa.Table:
        group = table.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        return work(table, group, np.unique(group, return_index=True)[1], TaskRows(table, used))

    return shipped(rows).groupBy("_part").applyInArrow(run, StructType([*[df.schema[c] for c in keys], *fields]))


def taken(table: pa.Table, keys: list[str], at: np.ndarray) -> dict[str, pa.ChunkedArray]:
    """The keys at some rows; Spark takes times back in UTC only."""
    zoned = lambda x: x.cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(x.type) and x.type.tz else x
    return {c: zoned(table.column(c).take(at)) for c in keys}


class TaskRows:
    """A task's rows as arrays, and where their values are (not null): target, weight, and all variables of the equation."""

    def __init__(self, table: pa.Table, used: list[str]) -> None:
        there = lambda c: pc.is_valid(table.column(c)).to_numpy()
        self.y, self.w = (table.column(c).to_numpy() for c in ("_y", "_w"))
        self.data = {c: table.column(f"_u{i}").to_numpy() for i, c in enumerate(used)}
        self.has_y, self.has_w = there("_y"), there("_w")
        self.has_x = np.logical_and.reduce([there(f"_u{i}") for i in range(len(used))], axis=0) if used else np.ones(len(self.y), bool)

    def fit(self, at: np.ndarray, group: np.ndarray, groups: int, equation: Equation, start: dict[str, float], rounds: int, tolerance: float) -> Arrays:
        """Fits on the rows ``at``, each of them in its ``group``."""
        whole = (self.has_y & self.has_w & self.has_x)[at]
        at, group = at[whole], group[whole]
        with np.errstate(all="ignore"):
            rows = Rows(group, groups, self.y[at], self.w[at], {c: x[at] for c, x in self.data.items()})
        return descended(rows, equation, start, rounds, tolerance)


def fit_groups(df: DataFrame, keys: list[str], equation: Equation, target: str, start: dict[str, float], weight: str | None = None, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Rows (keys, values of the names in ``start``, n, rss, converged): one fit of ``equation`` per group.

    Damped Gauss-Newton steps for all groups together: a round is one sum over the rows of the
    products of numerical derivatives at each group's trial values, and a small solve on the
    result. Rows with a null in target, weight or variables take no part. Groups whose sums
    never become finite keep their start values and are not converged.
    """
    names = list(start)
    near, far, parts = apart(df, keys)
    out = None if far is None else fit_in_rounds(far, keys, equation, target, start, weight, rounds, tolerance)
    if near is None:
        return out
    fields = [*(StructField(m, DoubleType()) for m in names), StructField("n", LongType()), StructField("rss", DoubleType()), StructField("converged", BooleanType())]

    def work(table: pa.Table, group: np.ndarray, first: np.ndarray, rows: TaskRows) -> pa.Table:
        groups = len(first)
        s = rows.fit(np.arange(len(group)), group, groups, equation, start, rounds, tolerance)
        got = {m: pa.array(s["values"][:, i]) for i, m in enumerate(names)} | {"n": pa.array(np.bincount(group, weights=rows.has_y, minlength=groups).astype(np.int64)), "rss": pa.array(s["best"], mask=~np.isfinite(s["best"])), "converged": pa.array(s["converged"])}
        return pa.table({**taken(table, keys, first), **got})

    fits = in_tasks(near, keys, parts, equation, names, target, weight, [], fields, work)
    return fits if out is None else fits.unionByName(out)


def fit_in_rounds(df: DataFrame, keys: list[str], equation: Equation, target: str, start: dict[str, float], weight: str | None, rounds: int, tolerance: float) -> DataFrame:
    """``fit_groups`` of groups of any length: a round is one aggregation of the rows."""
    names = list(start)
    y, w = F.col(target).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    k = len(names)

    def at(name: str | None = None, side: int = 0) -> Column:
        bind = {m: F.col(f"_try_{m}") + (F.col(f"_try_{m}_step") * side if m == name else 0) for m in names}
        return equation.column(bind)

    steps = {f"_try_{m}_step": F.greatest(F.abs(F.col(f"_try_{m}")), F.lit(1e-3)) * 1e-6 for m in names}
    slopes = {f"_s{i}": (at(m, 1) - at(m, -1)) / (2 * F.col(f"_try_{m}_step")) for i, m in enumerate(names)}
    size = k * k + k
    fields = ", ".join([*(f"`{m}` double" for m in names), *(f"_try_{m} double" for m in names), "_loss double", "_damping double", "_sums array<double>", "n long", "rss double", "converged boolean", "_done boolean"])

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            numbers = lambda columns: b[columns].to_numpy(dtype=float)  # noqa: E731, B023
            sums = np.array([v if v is not None and len(v) else [np.nan] * size for v in b["_sums"]], dtype=float)
            s = {"values": numbers(names), "trial": numbers([f"_try_{m}" for m in names]), "best": numbers("_loss"), "damping": numbers("_damping"), "sums": sums, "now": numbers([f"_m{i}" for i in range(size)]), "found": numbers("_new")}
            with np.errstate(all="ignore"):
                s = stepped(s, k, tolerance)
            best = pd.Series(s["best"], index=b.index)
            got = {m: s["values"][:, i] for i, m in enumerate(names)} | {f"_try_{m}": s["trial"][:, i] for i, m in enumerate(names)}
            yield b[keys].assign(**got, _loss=best, _damping=s["damping"], _sums=s["sums"].tolist(), n=b["_n"], rss=best.where(np.isfinite(best)), converged=s["converged"], _done=s["done"])

    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    state = groups.select(*keys, *[F.lit(float(v)).alias(m) for m, v in start.items()], *[F.lit(float(v)).alias(f"_try_{m}") for m, v in start.items()])
    state = state.withColumns({"_loss": F.lit(float("inf")), "_damping": F.lit(1e-6), "_sums": F.array().cast("array<double>"), "n": F.lit(0).cast("long"), "rss": F.lit(None).cast("double"), "converged": F.lit(False), "_done": F.lit(False)})
    state = settled(state)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), fields])
    finished, whole = [], y.isNotNull() & w.isNotNull()
    for _ in range(rounds):
        left = state.count()
        if not left:
            break
        tries = state.select(*keys, *[F.col(f"_try_{m}") for m in names])
        met = meeting(df, tries, keys, left).withColumns(steps).withColumns(slopes).withColumn("_gap", y - at())
        s = [F.when(whole, F.col(f"_s{i}")) for i in range(k)]
        sums = [F.sum(w * s[i] * s[j]) for i in range(k) for j in range(k)] + [F.sum(w * s[i] * F.col("_gap")) for i in range(k)]
        sums = [v.alias(f"_m{i}") for i, v in enumerate(sums)] + [F.sum(w * F.col("_gap") * F.col("_gap")).alias("_new"), F.count(y).alias("_n")]
        moments = met.groupBy(*keys).agg(*sums)
        known = state.join(moments, keys) if keys else state.crossJoin(F.broadcast(moments))
        state = settled(shipped(known.drop("n", "rss", "converged", "_done")).mapInPandas(advance, schema))
        finished.append(state.filter("_done"))
        state = state.filter("not _done")
    out = state
    for f in finished:
        out = out.unionByName(f)
    return out.select(*keys, *[F.col(f"`{m}`") for m in names], "n", "rss", "converged")


def named(equation: Equation, columns: list[str]) -> tuple[Equation, dict[str, float]]:
    """``equation`` with every number that can be fitted as a name, and the start values of all free names."""
    free = equation.free(columns)
    if free or equation.coefficients:
        return Equation(equation.text), {**{n: 0.1 for n in free}, **equation.coefficients}
    p = equation.parameterised(columns)
    return Equation(p.text), dict(p.coefficients)


def with_roles(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Rows of (fold, role): every row tests its own fold and trains the others; ``folds`` copies of each row."""
    own = F.col(fold)
    spread = df.withColumn("_f", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return spread.withColumn("role", F.when(F.col("_f") == own, "test").otherwise("train")).withColumn(fold, F.col("_f").cast("int")).drop("_f")


def cross_validate_equation(roles: DataFrame, keys: list[str], equation: Equation, target: str, weight: str | None = None, refit: bool = True) -> DataFrame:
    """Per key and fold of ``roles`` (fold, role): scores of ``equation`` refitted on the training rows.

    Numbers of a found equation, or the coefficients and free names of a given one, are
    fitted; where a fit fails the equation's own values stand and ``refitted`` is false.
    R^2 is about the (weighted) mean of the training rows. Returns keys, fold, n_train,
    n_test, rmse, mae, ss_res, ss_tot, r_squared, deviance (weighted mean squared error),
    mass (of the test weights), refitted.
    """
    by = [*keys, "fold"]
    form, start = named(equation, roles.columns)
    near, far, parts = apart(roles, by)

    def parted(table: pa.Table, group: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
        role = table.column("_role").to_numpy()
        train, test = np.flatnonzero(role == "train"), np.flatnonzero(role == "test")
        return train, group[train], test, group[test]

    out = None if near is None else scored(near, by, parts, None, F.col("role").alias("_role"), parted, form, start, target, weight, refit)
    return told(out, None if far is None else scored_in_rounds(far, by, form, start, target, weight, refit))


def cross_validate_folds(df: DataFrame, keys: list[str], equation: Equation, target: str, weight: str | None = None, folds: int = 5, fold: str = "fold", refit: bool = True) -> DataFrame:
    """``cross_validate_equation`` where every row tests its own fold (1..``folds``) and trains the others.

    Rows go to tasks once; the training rows of each fold are taken from them there.
    """
    form, start = named(equation, df.columns)
    near, far, parts = apart(df, keys)

    def parted(table: pa.Table, group: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
        of = np.nan_to_num(table.column("_fold").to_numpy().astype(float))  # a row without a fold trains all
        trains, tests = ([np.flatnonzero((of == f) == own) for f in range(1, folds + 1)] for own in (False, True))
        numbers = [np.concatenate([group[at] * folds + f for f, at in enumerate(each)]) for each in (trains, tests)]
        return np.concatenate(trains), numbers[0], np.concatenate(tests), numbers[1]

    out = None if near is None else scored(near, keys, parts, folds, F.col(fold).cast("double").alias("_fold"), parted, form, start, target, weight, refit)
    if far is not None:
        used = {*keys, fold, target, *form.names(), *([weight] if weight else [])}
        kept = settled(far.select(*[c for c in far.columns if c in used]))  # every round makes its copies from it
        far = scored_in_rounds(with_roles(kept, folds, fold).withColumnRenamed(fold, "fold"), [*keys, "fold"], form, start, target, weight, refit)
    return told(out, far)


def scored(df: DataFrame, keys: list[str], parts: int, folds: int | None, mark: Column, parted: Callable[[pa.Table, np.ndarray, int], tuple[np.ndarray, ...]], form: Equation, start: dict[str, float], target: str, weight: str | None, refit: bool, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Fits and scores inside tasks. ``parted`` gives training rows, their fits, test rows and their fits; a group has a fit for each of ``folds``, one without."""
    each = folds or 1
    of_fold = [StructField("fold", IntegerType())] if folds else []
    numbers = ("rmse", "mae", "ss_res", "ss_tot", "deviance", "mass")
    fields = [*of_fold, StructField("n_train", LongType()), StructField("n_test", LongType()), *(StructField(c, DoubleType()) for c in numbers), StructField("refitted", BooleanType())]
    begin = np.array(list(start.values()), dtype=float)
    own = Equation(form.text, {m: v for m, v in form.coefficients.items() if m not in start})

    def work(table: pa.Table, group: np.ndarray, first: np.ndarray, rows: TaskRows) -> pa.Table:
        fits = len(first) * each
        train, of, test, fit = parted(table, group, len(first))
        total = lambda number, x, where: (np.bincount(number[where], weights=np.broadcast_to(x, len(number))[where], minlength=fits), np.bincount(number[where], minlength=fits))
        y, w, has_y, has_w = rows.y, rows.w, rows.has_y, rows.has_w
        n_train = total(of, 1.0, has_y[train])[1]
        values, good = np.tile(begin, (fits, 1)), np.zeros(fits, bool)
        if refit and start:
            s = rows.fit(train, of, fits, form, start, rounds, tolerance)
            good = s["converged"] & (n_train >= len(start))
            values = np.where(good[:, None], s["values"], values)
        with np.errstate(all="ignore"):
            weighted, some = total(of, (w * y)[train], (has_w & has_y)[train])
            heavy = total(of, w[train], has_w[train])[0]
            mean = weighted / heavy
            has_mean = (some > 0) & (heavy != 0)
            e = y[test] - own.values({**{c: x[test] for c, x in rows.data.items()}, **{m: values[fit, i] for i, m in enumerate(start)}})
            d, there = y[test] - mean[fit], (has_y & rows.has_x)[test]
            square, n = total(fit, e * e, there)
            about, n_about = total(fit, d * d, has_y[test] & has_mean[fit])
            lost, n_lost = total(fit, w[test] * e * e, there & has_w[test])
            mass, n_mass = total(fit, w[test], has_w[test])
            got = {"rmse": (np.sqrt(square / n), n), "mae": (total(fit, np.abs(e), there)[0] / n, n), "ss_res": (square, n), "ss_tot": (about, n_about), "deviance": (lost / mass, n_lost * (mass != 0)), "mass": (mass, n_mass)}
        kept = np.flatnonzero((np.bincount(of, minlength=fits) > 0) & (np.bincount(fit, minlength=fits) > 0))
        out = taken(table, keys, first[kept // each])
        if folds:
            out["fold"] = pa.array((kept % each + 1).astype(np.int32))
        out |= {"n_train": pa.array(n_train[kept].astype(np.int64)), "n_test": pa.array(total(fit, 1.0, has_y[test])[1][kept].astype(np.int64))}
        return pa.table({**out, **{c: pa.array(x[kept], mask=(n[kept] == 0)) for c, (x, n) in got.items()}, "refitted": pa.array(good[kept])})

    return in_tasks(df, keys, parts, form, list(start), target, weight, [mark], fields, work)


def told(near: DataFrame | None, far: DataFrame | None) -> DataFrame:
    s = far if near is None else near if far is None else near.unionByName(far)
    return s.withColumn("r_squared", 1 - F.col("ss_res") / F.nullif(F.col("ss_tot"), F.lit(0.0)))


def scored_in_rounds(roles: DataFrame, by: list[str], form: Equation, start: dict[str, float], target: str, weight: str | None, refit: bool, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Fits and scores of groups of any length."""
    y, w = F.col(target).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    train, test = roles.filter("role = 'train'"), roles.filter("role = 'test'")
    means = train.groupBy(*by).agg((F.sum(w * y) / F.nullif(F.sum(w), F.lit(0.0))).alias("_mean"), F.count(y).alias("n_train"))
    if refit and start:
        fits = fit_in_rounds(train, by, form, target, start, weight, rounds, tolerance)
        good = F.col("converged") & (F.col("n") >= len(start))
        fits = fits.select(*by, *[F.when(good, F.col(f"`{m}`")).otherwise(F.lit(float(v))).alias(f"_p_{m}") for m, v in start.items()], good.alias("refitted"))
        means = means.join(fits, by, "left")
    else:
        means = means.select("*", *[F.lit(float(v)).alias(f"_p_{m}") for m, v in start.items()], F.lit(False).alias("refitted"))
    e = y - form.column({m: F.col(f"_p_{m}") for m in start})
    met = test.join(means, by).withColumn("_e", e).withColumn("_d", y - F.col("_mean"))
    e, d = F.col("_e"), F.col("_d")
    return met.groupBy(*by).agg(F.first("n_train").alias("n_train"), F.count(y).alias("n_test"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("ss_res"), F.sum(d * d).alias("ss_tot"), (F.sum(w * e * e) / F.nullif(F.sum(w), F.lit(0.0))).alias("deviance"), F.sum(w).alias("mass"), F.first("refitted").alias("refitted"))


def blocked_score(df: DataFrame, panel: Panel, equation: Equation, target: str, weight: str, blocks: int = 5) -> DataFrame:
    """Weighted deviance over ``blocks`` blocks by time, each of the equation refitted on the other blocks, weighted by mass."""
    d = row_numbers(df, panel)
    d = d.withColumn("fold", F.least(F.lit(blocks), F.floor((F.col("rn") * blocks - 1) / F.col("n")) + 1).cast("int"))
    scores = cross_validate_folds(d, list(panel.keys), equation, target, weight, blocks).filter("n_test >= 2")
    return scores.groupBy(*panel.keys).agg((F.sum(F.col("deviance") * F.col("mass")) / F.sum("mass")).alias("score"), F.min(F.col("refitted")).alias("refitted"))
