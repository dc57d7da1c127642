"""Nonlinear least squares within bounds for many groups at once, by a cascade of methods.

A method goes in rounds: sums over a group's rows at its trial values, and a small step on these.
Groups of up to MOST_LOCAL rows are dealt to tasks some tens of thousands of rows at a time, where
all rounds of all groups run together; rounds cost no jobs there. For longer groups every round is
one aggregation of the rows; trial values go to them by a broadcast while groups are few, else by
a join on the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.equations import Equation
from ..shipping import shipped
from .lineage import settled

#: Groups whose trial values are broadcast; more are joined.
MOST_BROADCAST = 200_000
#: Rows up to which a group is fitted inside a task, and about how many rows of groups a task takes at once.
MOST_LOCAL, PART = 20_000, 50_000
#: Values that a group whose start gives no finite loss tries for each name, within its bounds.
GRID = (-10.0, -1.0, -0.1, 0.1, 1.0, 10.0)
DOUBLES = ArrayType(DoubleType())
Arrays = dict[str, np.ndarray]


def meeting(rows: DataFrame, state: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """Every row beside the state of its group."""
    if not keys:
        return rows.crossJoin(F.broadcast(state))  # one row
    return rows.join(F.broadcast(state) if n_groups <= MOST_BROADCAST else state, keys)


class Method:
    """Rounds of one method: ``sums`` of rows as Columns or, by ``summed``, in a task, and a ``step`` of the states of many groups.

    A state has arrays of one entry per group: those in ``shapes``, and n, done and good.
    """

    shapes: dict[str, tuple[int, ...]]

    def __init__(self, equation: Equation, names: list[str], low: np.ndarray, high: np.ndarray, tolerance: float) -> None:
        self.equation, self.names, self.low, self.high, self.tolerance, self.k = equation, names, low, high, tolerance, len(names)
        self.own = Equation(equation.text, {m: v for m, v in equation.coefficients.items() if m not in names})

    def begin(self, starts: np.ndarray) -> Arrays:
        raise NotImplementedError

    def sums(self) -> list[Column]:
        raise NotImplementedError

    def summed(self, rows: Rows, state: Arrays) -> Arrays:
        raise NotImplementedError

    def step(self, s: Arrays) -> Arrays:
        raise NotImplementedError

    def result(self, s: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best values, their loss, and whether it is of use."""
        raise NotImplementedError

    def gap(self, at: list[Column]) -> Column:
        return F.col("_y") - self.equation.column(dict(zip(self.names, at, strict=True)))

    def loss(self, at: list[Column]) -> Column:
        """Weighted sum of squares; null where a prediction is not a number."""
        e = self.gap(at)
        return F.when(F.count(e) == F.count("_y"), F.sum(F.col("_w") * e * e))

    def gaps(self, rows: Rows, at: list[np.ndarray]) -> np.ndarray:
        return rows.y - self.own.values({**rows.data, **dict(zip(self.names, at, strict=True))}) + rows.missing


class Rows:
    """Rows of many groups in a task: ``group`` numbers each row's group."""

    def __init__(self, group: np.ndarray, groups: int, y: np.ndarray, w: np.ndarray, data: Arrays) -> None:
        self.group, self.groups, self.y, self.w, self.data = group, groups, y, w, data
        self.missing = sum((x * 0.0 for x in data.values()), np.zeros(len(y)))  # NaN where a value is
        self.n = np.bincount(group, minlength=groups)

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, weights=np.broadcast_to(x, len(self.y)), minlength=self.groups)

    def of(self, kept: np.ndarray) -> Rows:
        """The rows of some groups, numbered anew."""
        number = np.cumsum(kept) - 1
        at = np.flatnonzero(kept[self.group])
        return Rows(number[self.group[at]], int(kept.sum()), self.y[at], self.w[at], {c: x[at] for c, x in self.data.items()})


class Steps(Method):
    """Damped Gauss-Newton steps projected on the box.

    Names that stand at a bound and would go beyond it are held; the others take the step
    of the system without them, cut at the box.
    """

    def __init__(self, *given) -> None:
        super().__init__(*given)
        self.shapes = {"trial": (self.k,), "best": (self.k,), "sums": (self.k * self.k + self.k,), "loss": (), "damping": ()}

    def begin(self, starts: np.ndarray) -> Arrays:
        g = len(starts)
        return {"trial": starts, "best": starts, "sums": np.full((g, self.k * self.k + self.k), np.nan), "loss": np.full(g, np.inf), "damping": np.full(g, 1e-3)}

    def sums(self) -> list[Column]:
        k = self.k
        v = [F.get("trial", F.lit(i)) for i in range(k)]
        bound = [(F.lit(float(lo)), F.lit(float(hi))) for lo, hi in zip(self.low, self.high, strict=True)]
        h = [F.greatest(F.abs(c), F.lit(1e-3)) * 1e-6 for c in v]
        up = [F.least(c + d, b[1]) for c, d, b in zip(v, h, bound, strict=True)]
        down = [F.greatest(c - d, b[0]) for c, d, b in zip(v, h, bound, strict=True)]
        at = lambda i, c: self.gap([*v[:i], c, *v[i + 1 :]])
        slope = [(at(i, down[i]) - at(i, up[i])) / F.nullif(up[i] - down[i], F.lit(0.0)) for i in range(k)]
        slope = [F.coalesce(s, F.lit(0.0)) if lo == hi else s for s, lo, hi in zip(slope, self.low, self.high, strict=True)]
        w, e = F.col("_w"), self.gap(v)
        sums = [F.sum(w * slope[i] * slope[j]) for i in range(k) for j in range(k)] + [F.sum(w * s * e) for s in slope]
        return [F.array(*sums).alias("now"), self.loss(v).alias("found"), F.count("_y").alias("rows")]

    def summed(self, rows: Rows, state: Arrays) -> Arrays:
        k, slope = self.k, []
        v = [state["trial"][rows.group, i] for i in range(k)]
        e = self.gaps(rows, v)
        for i in range(k):
            h = np.maximum(np.abs(v[i]), 1e-3) * 1e-6
            up, down = np.minimum(v[i] + h, self.high[i]), np.maximum(v[i] - h, self.low[i])
            got = (self.gaps(rows, [*v[:i], down, *v[i + 1 :]]) - self.gaps(rows, [*v[:i], up, *v[i + 1 :]])) / np.where(up > down, up - down, np.nan)
            slope.append(np.nan_to_num(got, nan=0.0) if self.low[i] == self.high[i] else got)
        own = {(i, j): rows.total(rows.w * slope[i] * slope[j]) for i in range(k) for j in range(i, k)}
        now = [own[min(i, j), max(i, j)] for i in range(k) for j in range(k)] + [rows.total(rows.w * s * e) for s in slope]
        return {"now": np.stack(now, axis=1), "found": rows.total(rows.w * e * e), "rows": rows.n}

    def step(self, s: Arrays) -> Arrays:
        k, found, now, tolerance = self.k, s["found"], s["now"], self.tolerance
        finite = np.isfinite(found) & np.isfinite(now).all(axis=1)
        has = np.isfinite(s["sums"]).all(axis=1)
        better = finite & ~(found > s["loss"])
        same = finite & np.isfinite(s["loss"]) & (np.abs(s["loss"] - found) <= tolerance * (np.abs(found) + 1e-300))
        best, loss = np.where(better[:, None], s["trial"], s["best"]), np.where(better, found, s["loss"])
        known = np.where(better[:, None], now, s["sums"])
        damping = np.where(better, np.maximum(s["damping"] / 10, 1e-12), np.where(has, s["damping"] * 10, s["damping"]))
        over = np.where(better, same, damping > 1e12)
        useless = ~better & ~has  # the start itself is of no use
        known = np.where(useless[:, None], 0.0, known)
        jj, g = known[:, : k * k].reshape(-1, k, k), known[:, k * k :]
        steep = np.diagonal(jj, axis1=1, axis2=2)
        held = ((best <= self.low) & (g <= 0)) | ((best >= self.high) & (g >= 0))
        free = ~held & (steep > 0)
        scale = np.sqrt(np.where(free, steep, 1.0))
        both = free[:, :, None] & free[:, None, :]
        unit = np.where(both, jj / scale[:, :, None] / scale[:, None, :], 0.0) + np.where(free, damping[:, None], 1.0)[:, :, None] * np.eye(k)
        move = np.linalg.pinv(unit, rcond=k * np.finfo(float).eps) @ np.where(free, g / scale, 0.0)[:, :, None]
        trial = np.clip(best + move[:, :, 0] / scale, self.low, self.high)
        over = over | ((g * (trial - best)).sum(axis=1) <= 0.01 * tolerance * loss)  # all that this step could gain
        over = over | (np.abs(trial - best).max(axis=1) <= 1e-14 * (1 + np.abs(best).max(axis=1)))
        known = np.where(useless[:, None], np.nan, known)
        return {"trial": np.where(useless[:, None], best, trial), "best": best, "sums": known, "loss": loss, "damping": damping, "done": over | useless, "good": over & ~useless}

    def result(self, s: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return s["best"], s["loss"], s["good"]


class Simplex(Method):
    """The simplex method of Nelder and Mead, cut at the box, which needs no slopes.

    All points that the next move could need are scored in the same round.
    """

    def __init__(self, *given) -> None:
        super().__init__(*given)
        self.width = self.k + 4
        self.shapes = {"points": (self.k + 1, self.k), "losses": (self.k + 1,), "asked": (self.width, self.k)}

    def begin(self, starts: np.ndarray) -> Arrays:
        g, k = starts.shape
        side = np.where(starts != 0, 0.1 * np.abs(starts), 0.1)
        corners = starts[:, None, :] + np.concatenate([np.zeros((1, k)), np.eye(k)]) * side[:, None, :]
        inside = (np.clip(corners, self.low, self.high) == corners).all(axis=2)[:, :, None]
        corners = np.where(inside, corners, 2 * starts[:, None, :] - corners)
        asked = np.concatenate([corners, np.repeat(starts[:, None, :], self.width - k - 1, axis=1)], axis=1)
        return {"points": np.full((g, k + 1, k), np.nan), "losses": np.full((g, k + 1), np.nan), "asked": np.clip(asked, self.low, self.high)}

    def sums(self) -> list[Column]:
        asked = [[F.get(F.get("asked", F.lit(j)), F.lit(i)) for i in range(self.k)] for j in range(self.width)]
        return [F.array(*[self.loss(p) for p in asked]).alias("found"), F.count("_y").alias("rows")]

    def summed(self, rows: Rows, state: Arrays) -> Arrays:
        found = []
        for j in range(self.width):
            e = self.gaps(rows, [state["asked"][rows.group, j, i] for i in range(self.k)])
            found.append(rows.total(rows.w * e * e))
        return {"found": np.stack(found, axis=1), "rows": rows.n}

    def asked_of(self, x: np.ndarray) -> np.ndarray:
        centre = x[:, :-1].mean(axis=1)
        moves = [centre + t * (x[:, -1] - centre) for t in (-1.0, -2.0, -0.5, 0.5)]
        return np.clip(np.stack([*moves, *(x[:, 0] + 0.5 * (x[:, i] - x[:, 0]) for i in range(1, self.k + 1))], axis=1), self.low, self.high)

    def step(self, s: Arrays) -> Arrays:
        k = self.k
        found = np.where(np.isfinite(s["found"]), s["found"], np.inf)
        asked, first = s["asked"], np.isnan(s["losses"]).all(axis=1)
        x, f = s["points"], s["losses"]
        back, far, outer, inner = (found[:, i] for i in range(4))
        third = np.where((back < f[:, -1]) & (outer <= back), 2, np.where(inner < f[:, -1], 3, -1))
        pick = np.where(back < f[:, 0], np.where(far < back, 1, 0), np.where((k > 0) & (back < f[:, -2]), 0, third))
        last = np.where(pick < 0, 0, pick)
        moved_x = np.concatenate([x[:, :-1], np.take_along_axis(asked, last[:, None, None], axis=1)], axis=1)
        moved_f = np.concatenate([f[:, :-1], np.take_along_axis(found, last[:, None], axis=1)], axis=1)
        shrunk_x, shrunk_f = np.concatenate([x[:, :1], asked[:, 4:]], axis=1), np.concatenate([f[:, :1], found[:, 4:]], axis=1)
        x = np.where(first[:, None, None], asked[:, : k + 1], np.where((pick < 0)[:, None, None], shrunk_x, moved_x))
        f = np.where(first[:, None], found[:, : k + 1], np.where((pick < 0)[:, None], shrunk_f, moved_f))
        order = np.argsort(f, axis=1, kind="stable")
        x, f = np.take_along_axis(x, order[:, :, None], axis=1), np.take_along_axis(f, order, axis=1)
        with np.errstate(invalid="ignore"):
            near = f[:, -1] - f[:, 0] <= self.tolerance * (np.abs(f[:, 0]) + 1e-300)
        over = np.isfinite(f).all(axis=1) & near & (np.abs(x - x[:, :1]).max(axis=(1, 2)) <= 1e-6 * (1 + np.abs(x[:, 0]).max(axis=1)))
        return {"points": x, "losses": f, "asked": self.asked_of(x), "done": over | ~np.isfinite(f).any(axis=1), "good": over}  # or nowhere to go

    def result(self, s: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return s["points"][:, 0], s["losses"][:, 0], s["good"] | (s["losses"][:, 0] < np.inf)


def together(method: Method, rows: Rows, starts: np.ndarray, most: int) -> Arrays:
    """The last states of all groups of a task."""
    state = {**method.begin(starts), "n": np.zeros(len(starts), int), "done": np.zeros(len(starts), bool), "good": np.zeros(len(starts), bool)}
    left, out = np.arange(len(starts)), {c: x.copy() for c, x in state.items()}
    with np.errstate(all="ignore"):
        for _ in range(most):
            got = method.summed(rows, state)
            state = {**method.step({**state, **got}), "n": got["rows"]}
            for c, x in state.items():
                out[c][left] = x
            going = ~state["done"]
            if not going.any():
                break
            if going.mean() < 0.8:  # else groups that are done stay as they are
                rows, left, state = rows.of(going), left[going], {c: x[going] for c, x in state.items()}
    return out


class Fit:
    """What all methods of one fit share: the rows, the equation, the box, and which groups are fitted inside tasks."""

    def __init__(self, df: DataFrame, keys: list[str], equation: Equation, target: str, names: list[str], lower: dict[str, float], upper: dict[str, float], weight: str | None) -> None:
        self.keys, self.equation, self.names = keys, equation, names
        self.low = np.array([float(lower.get(m, -np.inf)) for m in names])
        self.high = np.array([float(upper.get(m, np.inf)) for m in names])
        if (self.low > self.high).any():
            raise ValueError("a lower bound is above its upper bound")
        self.used = [c for c in equation.names() if c in df.columns and c not in names]
        y = F.col(target).cast("double")
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = df.select(*keys, *[F.col(c) for c in self.used if c not in keys], y.alias("_y"), w.alias("_w"))
        self.rows = rows.filter("_y is not null and _w is not null").persist(StorageLevel.MEMORY_AND_DISK)
        self.local = 0  # rows of groups that are fitted inside tasks
        self.long = None  # keys of the other groups, none if there are none
        if keys:
            self.sized = settled(self.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
            small = F.col("_size") <= MOST_LOCAL
            self.local, long = self.sized.agg(F.coalesce(F.sum(F.when(small, F.col("_size"))), F.lit(0)), F.count_if(~small)).first()
            self.long = self.sized.filter(~small).select(*keys) if long else None

    def method(self, kind: type[Method], tolerance: float) -> Method:
        return kind(self.equation, self.names, self.low, self.high, tolerance)

    def schema(self, fields: list[StructField]) -> StructType:
        return StructType([*[f for f in self.rows.schema.fields if f.name in self.keys], *fields])

    def groups(self) -> DataFrame:
        return self.sized.select(*self.keys) if self.keys else self.rows.sparkSession.range(1).select()

    def run(self, method: Method, starts: DataFrame, most: int) -> DataFrame:
        """From ``starts`` (keys, start): (keys, best, loss, n, good, settled)."""
        if not self.keys:
            return self.in_rounds(method, starts, most)
        near = starts if self.long is None else starts.join(F.broadcast(self.long), self.keys, "left_anti")  # long groups: rows / MOST_LOCAL at most
        out = self.in_tasks(method, near, most)
        if self.long is not None:
            out = out.unionByName(self.in_rounds(method, starts.join(F.broadcast(self.long), self.keys, "left_semi"), most))
        return settled(out)

    def in_tasks(self, method: Method, starts: DataFrame, most: int) -> DataFrame:
        keys, used = self.keys, self.used
        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        parts = max(1, -(-self.local // PART), min(2 * cores, self.local // 2000))
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("_part")
        # By a number of partitions: few bytes can be much work, which adaptive execution would put into one task.
        rows = self.rows if self.long is None else self.rows.join(F.broadcast(self.long), keys, "left_anti")
        rows = rows.select(part, *keys, *[F.col(c).cast("double").alias(f"_u{i}") for i, c in enumerate(used)], "_y", "_w").repartition(min(parts, 2000), "_part")
        starts = starts.select(part, *keys, "start").repartition(min(parts, 2000), "_part")
        fields = [StructField("best", DOUBLES), StructField("loss", DoubleType()), StructField("n", LongType()), StructField("good", BooleanType()), StructField("settled", BooleanType())]

        def fit(b: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            if not len(of):
                return pd.DataFrame(columns=[*keys, *(f.name for f in fields)])
            number = pd.concat([of[keys], b[keys]], ignore_index=True).groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            groups, group = len(of), number[len(of) :]
            b, group = b[group < groups], group[group < groups]
            rows = Rows(group, groups, b["_y"].to_numpy(float), b["_w"].to_numpy(float), {c: b[f"_u{i}"].to_numpy(float) for i, c in enumerate(used)})
            s = together(method, rows, np.array(of["start"].tolist(), dtype=float).reshape(groups, method.k), most)
            best, loss, good = method.result(s)
            return of[keys].assign(best=best.tolist(), loss=loss, n=s["n"], good=good, settled=s["good"])

        return shipped(rows).groupBy("_part").cogroup(starts.groupBy("_part")).applyInPandas(fit, self.schema(fields))

    def in_rounds(self, method: Method, starts: DataFrame, most: int) -> DataFrame:
        keys, shapes = self.keys, method.shapes
        kind = lambda n: DOUBLES if n == 1 else ArrayType(DOUBLES) if n == 2 else DoubleType()
        fields = [*(StructField(c, kind(len(d))) for c, d in shapes.items()), StructField("n", LongType()), StructField("done", BooleanType()), StructField("good", BooleanType())]

        def arrays(b: pd.DataFrame, c: str) -> np.ndarray:
            return np.array([[np.array(p, dtype=float) for p in v] for v in b[c]] if len(shapes.get(c, ())) == 2 else [np.array(v, dtype=float) for v in b[c]], dtype=float)

        def table(b: pd.DataFrame, s: Arrays) -> pd.DataFrame:
            return b[keys].assign(**{f.name: s[f.name].tolist() for f in fields})

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                s = method.begin(np.array(b["start"].tolist(), dtype=float).reshape(len(b), method.k)) if len(b) else {}
                no = np.zeros(len(b), bool)
                yield table(b, {**s, "n": np.zeros(len(b), int), "done": no, "good": no}) if len(b) else b.reindex(columns=[*keys, *(f.name for f in fields)])

        def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    with np.errstate(all="ignore"):
                        got = method.step({c: arrays(b, c) for c in (*shapes, *(c for c in ("now", "found") if c in b.columns))})
                    yield table(b, {**got, "n": b["rows"].to_numpy()})

        def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    best, loss, good = method.result({c: arrays(b, c) for c in shapes} | {"good": b["good"].to_numpy(bool)})
                    yield b[keys].assign(best=best.tolist(), loss=loss, n=b["n"], good=good, settled=b["good"])

        schema, finished = self.schema(fields), []
        state = settled(shipped(starts).mapInPandas(first, schema))
        for _ in range(most):
            left = state.count()
            if not left:
                break
            got = meeting(self.rows, state, keys, left).groupBy(*keys).agg(*method.sums())
            known = state.join(got, keys) if keys else state.crossJoin(F.broadcast(got))
            state = settled(shipped(known).mapInPandas(advance, schema))
            finished.append(state.filter("done"))
            state = state.filter("not done")
        for f in finished:
            state = state.unionByName(f)
        return state.mapInPandas(last, self.schema([StructField("best", DOUBLES), StructField("loss", DoubleType()), StructField("n", LongType()), StructField("good", BooleanType()), StructField("settled", BooleanType())]))

    def grid_starts(self, groups: DataFrame) -> DataFrame:
        """(keys, start): the point of the grid of GRID values within the box that has the least finite loss, per group."""
        points = [[]]
        for lo, hi in zip(self.low, self.high, strict=True):
            values = sorted({float(np.clip(x, lo, hi)) for x in GRID})
            points = [[*p, x] for p in points for x in values]
        n, best, of = groups.count(), None, self.method(Steps, 0.0)
        for at in range(0, len(points), 216):  # columns of one aggregation
            part = points[at : at + 216]
            scores = [F.struct(F.coalesce(F.nanvl(of.loss([F.lit(x) for x in p]), F.lit(float("inf"))), F.lit(float("inf"))).alias("loss"), F.lit(at + i).alias("i"), F.array(*[F.lit(x) for x in p]).alias("start")) for i, p in enumerate(part)]
            got = meeting(self.rows, groups, self.keys, n).groupBy(*self.keys).agg(F.array_min(F.array(*scores)).alias("_least"))
            best = got if best is None else best.unionByName(got)
        least = best.groupBy(*self.keys).agg(F.min("_least").alias("_least"))
        return least.select(*self.keys, F.col("_least.start").alias("start"))


def fit_bounded(df: DataFrame, keys: list[str], equation: Equation, target: str, start: dict[str, float], lower: dict[str, float] | None = None, upper: dict[str, float] | None = None, weight: str | None = None, rounds: int = 100, tolerance: float = 1e-13) -> DataFrame:
    """Rows (keys, the names of ``start``, n, rss, converged, method, at_bound): one bounded fit of ``equation`` per group.

    A cascade: damped steps from ``start``; where that start gives no finite loss or does not
    settle, damped steps from the best of a grid of starts; where that does not settle
    either, a simplex, which needs no slopes. ``method`` (steps, grid or simplex) says which
    one won, ``at_bound`` which names end on a bound. Bounds are given by name, a name without one
    is free to that side; a start outside is moved to the bound. Rows without a target or weight
    are left out; a group for which no method finds a finite loss has null values.
    """
    fit = Fit(df, keys, equation, target, list(start), lower or {}, upper or {}, weight)
    names = fit.names
    begin = np.clip([float(v) for v in start.values()], fit.low, fit.high)
    steps = fit.method(Steps, tolerance)
    done = fit.run(steps, fit.groups().select(*keys, F.array(*[F.lit(float(v)) for v in begin]).alias("start")), rounds)
    parts = [done.filter("good").withColumns({"method": F.lit("steps"), "converged": F.lit(True)})]
    open_ = done.filter("not good")
    if not open_.isEmpty():
        starts = settled(fit.grid_starts(open_.select(*keys)))
        again = fit.run(steps, starts, rounds)
        parts.append(again.filter("good").withColumns({"method": F.lit("grid"), "converged": F.lit(True)}))
        open_ = again.filter("not good").select(*keys, F.col("best").alias("start"))
        if not open_.isEmpty():
            last = fit.run(fit.method(Simplex, 1e-10), open_, 200)
            parts.append(last.withColumns({"method": F.lit("simplex"), "converged": F.col("settled"), "best": F.when(F.col("good"), F.col("best"))}))
    out = parts[0].drop("settled")
    for p in parts[1:]:
        out = out.unionByName(p.drop("settled"))
    value = [F.get("best", F.lit(i)) for i in range(len(names))]
    bound = [F.when((v <= float(lo)) | (v >= float(hi)), F.lit(m)) for v, m, lo, hi in zip(value, names, fit.low, fit.high, strict=True)]
    out = out.select(*keys, *[v.alias(m) for v, m in zip(value, names, strict=True)], "n", F.when(F.col("loss") < float("inf"), F.col("loss")).alias("rss"), "converged", "method", F.array_compact(F.array(*bound)).alias("at_bound"))
    out = settled(out)
    fit.rows.unpersist()
    return out
