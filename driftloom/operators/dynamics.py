"""Dynamics of fitted equations: simulation, fixed points and bifurcations."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.equations import Equation
from ..functions.errors import NameCollision, SubstitutionIgnored, UndeclaredName, UnknownName
from ..functions.scalars import finite
from ..shipping import shipped
from .lineage import settled
from .panel import Panel


def simulate(spark: SparkSession, drift: Equation, variable: str, start: float, step: float, steps: int, diffusion: Equation | None = None, sims: int = 1, method: str = "euler", seed: int = 42) -> DataFrame:
    """Rows (sim, step, t, value): paths of dz = drift dt + diffusion dW, one row of work per path.

    Noise is Box-Muller on hashes of (seed, path, step), so it does not depend on the
    partitioning. Methods: euler, milstein (numeric slope of the diffusion), rk4 (drift).
    Paths that leave the finite numbers are null from there on.
    """
    root = step**0.5

    def unit(i: Column, part: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.col("sim"), i, F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def f(z: Column, eq: Equation = drift) -> Column:
        return eq.column({variable: z})

    def move(z: Column, i: Column) -> Column:
        if method == "rk4":
            k1 = f(z)
            k2 = f(z + step / 2 * k1)
            k3 = f(z + step / 2 * k2)
            k4 = f(z + step * k3)
            new = z + step / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        else:
            new = z + step * f(z)
        if diffusion is not None:
            dw = F.sqrt(-2 * F.ln(unit(i, 1))) * F.cos(2 * 3.141592653589793 * unit(i, 2)) * root
            g = f(z, diffusion)
            new = new + g * dw
            if method == "milstein":
                slope = (f(z + 1e-6, diffusion) - f(z - 1e-6, diffusion)) / 2e-6
                new = new + 0.5 * g * slope * (dw * dw - step)
        return finite(new)

    paths = spark.range(1, sims + 1).select(F.col("id").cast("int").alias("sim"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.lit(float(start))), lambda acc, i: F.concat(acc, F.array(move(F.element_at(acc, -1), i))))
    rows = paths.withColumn("path", path).select("sim", F.posexplode("path").alias("step", "value"))
    return rows.withColumn("t", F.col("step") * step).select("sim", "step", "t", "value")


def simulate_at(spark: SparkSession, drift: Equation, variable: str, start: float, times: list[float], diffusion: Equation | None = None, sims: int = 1, method: str = "euler", exogenous: DataFrame | None = None, seed: int = 42, block: int = 256) -> DataFrame:
    """Rows (sim, step, t, value): paths at the given rising ``times``, which need not be even.

    ``exogenous`` has a column t and inputs, taken at every time by linear interpolation, the
    nearest value outside. Paths are split over tasks and advanced ``block`` at a time; a
    path's noise depends on (seed, path) only. Only the inputs at ``times`` come to the driver.
    Paths that leave the finite numbers are null from there on.
    """
    from .windows import interpolate

    at = np.asarray(times, dtype=float)
    if len(at) == 0 or not (np.diff(at) > 0).all():
        raise ValueError("times must rise")
    if method not in ("euler", "milstein", "rk4"):
        raise ValueError("method must be euler, milstein or rk4")
    names = [] if exogenous is None else [c for c in exogenous.columns if c != "t"]
    for e in (drift, diffusion):
        missing = [] if e is None else e.free([variable, "t", *names])
        if missing:
            raise UndeclaredName(f"no value for {', '.join(missing)}")
    inputs = {}
    if names:
        one = Panel(keys=("_one",))
        rows = spark.createDataFrame([(1, float(x)) for x in at], "_one int, t double")
        known = exogenous.withColumn("_one", F.lit(1))
        for c in names:
            rows = interpolate(rows, known.select("_one", "t", F.col(c).cast("double").alias(c)), one, c)
        got = rows.toPandas().sort_values("t")
        inputs = {c: got[c].to_numpy(float) for c in names}

    def value(e: Equation, z: np.ndarray, k: int, late: float = 0.0) -> np.ndarray:
        """The equation at ``late`` of the way from time k to the next."""
        n = min(k + 1, len(at) - 1)
        between = {c: x[k] + late * (x[n] - x[k]) for c, x in inputs.items()} | {"t": at[k] + late * (at[n] - at[k])}
        return np.broadcast_to(np.asarray(e.values(between | {variable: z}), dtype=float), z.shape)

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in range(0, len(b), block):
                sim = b["id"].to_numpy()[first : first + block]
                noise = np.stack([np.random.Generator(np.random.Philox(key=[seed, int(i)])).standard_normal(len(at)) for i in sim])
                path = np.full((len(sim), len(at)), float(start))
                with np.errstate(all="ignore"):
                    for k, dt in enumerate(np.diff(at)):
                        z = path[:, k]
                        if method == "rk4":
                            k1 = value(drift, z, k)
                            k2 = value(drift, z + dt / 2 * k1, k, 0.5)
                            k3 = value(drift, z + dt / 2 * k2, k, 0.5)
                            new = z + dt / 6 * (k1 + 2 * k2 + 2 * k3 + value(drift, z + dt * k3, k, 1.0))
                        else:
                            new = z + dt * value(drift, z, k)
                        if diffusion is not None:
                            g, dw = value(diffusion, z, k), noise[:, k] * np.sqrt(dt)
                            new = new + g * dw
                            if method == "milstein":
                                slope = (value(diffusion, z + 1e-6, k) - value(diffusion, z - 1e-6, k)) / 2e-6
                                new = new + 0.5 * g * slope * (dw * dw - dt)
                        path[:, k + 1] = np.where(np.isfinite(new) & np.isfinite(z), new, np.nan)
                yield pd.DataFrame({"sim": np.repeat(sim, len(at)), "step": np.tile(np.arange(len(at)), len(sim)), "t": np.tile(at, len(sim)), "value": path.ravel()})

    paths = shipped(spark.range(1, sims + 1)).mapInPandas(advance, "sim int, step int, t double, value double")
    return paths.withColumn("value", finite(F.col("value")))


def fan(paths: DataFrame) -> DataFrame:
    """Per time: mean, sd and quantiles (5, 25, 50, 75, 95 %) of the paths that are still finite."""
    q = F.percentile("value", F.array(*map(F.lit, [0.05, 0.25, 0.5, 0.75, 0.95])))
    s = paths.groupBy("step", "t").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return s.select("step", "t", "mean", "sd", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(["q05", "q25", "q50", "q75", "q95"])])


def compare(observed: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows (metric, value): how simulated paths' summary meets the observed values.

    The summary is taken at the observed times, linear between its own; observations
    outside of them do not count.
    """
    from .windows import interpolate

    columns = ["mean", "q50", "q05", "q95"]
    one = Panel(keys=("_one",), value="observed")
    known = summary.select(F.lit(1).alias("_one"), "t", F.struct(*columns).alias("s"))
    both = observed.withColumn("_one", F.lit(1))
    for c in columns:
        both = interpolate(both, known.select("_one", "t", F.col(f"s.{c}").alias(c)), one, c, clamp=False)
    both = both.filter(" and ".join(f"{c} is not null" for c in columns))
    y = F.col("observed")
    err = lambda c: F.sqrt(F.avg((y - F.col(c)) * (y - F.col(c))))
    inside = F.avg(((y >= F.col("q05")) & (y <= F.col("q95"))).cast("double"))
    s = both.agg(err("mean").alias("RMSE (mean)"), err("q50").alias("RMSE (median)"), F.avg(F.abs(y - F.col("mean"))).alias("MAD (mean)"), F.corr(y, "mean").alias("Correlation"), inside.alias("Coverage (90% CI)"))
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in s.columns])))


def fixed_points(grid: DataFrame, f: Callable[[Column], Column], keys: list[str], rounds: int = 60) -> DataFrame:
    """Rows (keys, fixed_point, stability, eigenvalue) from grid points ``z`` for each key.

    ``f`` gives the rate of change at a Column of states. Grid points where it is zero, and sign
    changes between neighbours halved ``rounds`` times, are roots; roots closer than half a
    grid step are one. The slope there, by central differences, tells the stability.
    """
    def at(z: Column) -> Column:
        return F.element_at(F.transform(F.array(z), lambda v: f(v)), 1)  # z is evaluated once

    w = W.partitionBy(*keys).orderBy("z")
    d = grid.withColumn("f", finite(at(F.col("z")))).filter("f is not null")
    d = d.withColumn("z2", F.lead("z").over(w)).withColumn("f2", F.lead("f").over(w)).withColumn("step", F.min(F.col("z2") - F.col("z")).over(W.partitionBy(*keys)))
    d = d.filter("f = 0 or f * f2 < 0")

    def halve(acc: Column, _: Column) -> Column:
        m = (acc["a"] + acc["b"]) / 2
        left = F.signum(at(acc["a"])) * F.signum(at(m)) <= 0
        return F.struct(F.when(left, acc["a"]).otherwise(m).alias("a"), F.when(left, m).otherwise(acc["b"]).alias("b"))

    bracket = F.struct(F.col("z").alias("a"), F.col("z2").alias("b"))
    closed = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), bracket, halve)
    d = d.withColumn("_c", F.when(F.col("f") != 0, closed))
    d = d.withColumn("root", F.when(F.col("f") == 0, F.col("z")).otherwise((F.col("_c.a") + F.col("_c.b")) / 2))
    before = F.lag("root").over(W.partitionBy(*keys).orderBy("root"))
    d = d.withColumn("_before", before).filter("_before is null or root - _before > step / 2")
    d = d.withColumn("eigenvalue", (at(F.col("root") + 1e-6) - at(F.col("root") - 1e-6)) / 2e-6)
    e = F.col("eigenvalue")
    stability = F.when(e.isNull() | F.isnan(e), "unknown").when(e < -1e-6, "stable").when(e > 1e-6, "unstable").otherwise("marginal")
    return d.select(*keys, F.col("root").alias("fixed_point"), stability.alias("stability"), "eigenvalue")


class Dynamics:
    """An equation dz = f(z; parameters) whose right-hand side is rebuilt for any value of z."""

    def __init__(self, equation: Equation, variable: str) -> None:
        self.equation, self.variable = equation, variable

    def __call__(self, z: Column) -> Column:
        return self.equation.column({self.variable: z})


def line(spark: SparkSession, low: float, high: float, points: int, name: str = "z") -> DataFrame:
    return spark.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias(name))


def declared(equation: Equation, variable: str, exogenous: dict[str, float] | None = None, coefficients: dict[str, float] | None = None, free: tuple[str, ...] = ()) -> Equation:
    """``equation`` with the given values as coefficients, after every name is accounted for.

    ``free`` names come from columns later. An exogenous value that the equation does not use is
    only warned about.
    """
    exogenous, coefficients = exogenous or {}, coefficients or {}
    used = set(equation.names())
    if variable in exogenous or variable in coefficients:
        raise NameCollision(f"{variable} is searched over and cannot have a value")
    both = set(exogenous) & (set(equation.coefficients) | set(coefficients))
    if both:
        raise NameCollision(f"coefficients, not exogenous: {', '.join(sorted(both))}")
    unknown = set(coefficients) - set(equation.coefficients) - set(equation.free([variable]))
    if unknown:
        raise UnknownName(f"the equation has no coefficient {', '.join(sorted(unknown))}")
    if set(exogenous) - used:
        warnings.warn(f"not in the equation: {', '.join(sorted(set(exogenous) - used))}", stacklevel=2)
    values = {**equation.coefficients, **coefficients, **exogenous}
    left = [n for n in used if n != variable and n not in values and n not in free]
    if left:
        raise UndeclaredName(f"no value for {', '.join(sorted(left))}")
    return Equation(equation.text, {k: float(v) for k, v in values.items() if k not in free}, equation.target)


def thin_draws(draws: DataFrame, n: int) -> DataFrame:
    """``n`` draws evenly spaced in order of ``draw``, which must number them from 1 without gaps."""
    low, high, count, distinct = draws.agg(F.min("draw"), F.max("draw"), F.count("draw"), F.countDistinct("draw")).first()
    if n >= count:
        return draws
    if (low, high) != (1, count) or distinct != count:
        raise UnknownName("draws must be numbered 1, 2, ... to be thinned")
    kept = sorted({round(float(x)) for x in np.linspace(1, count, n)})
    return draws.filter(F.col("draw").isin(kept))


def _drawn(equation: Equation, draws: DataFrame | None, fixed: set[str], n_draws: int | None) -> tuple[DataFrame | None, tuple[str, ...]]:
    """The thinned draws and the names of the equation that come from them; given values come before draws."""
    if draws is None:
        return None, ()
    names = tuple(c for c in draws.columns if c != "draw" and c not in fixed)
    ignored = [c for c in names if c not in equation.names()]
    if ignored:
        raise SubstitutionIgnored(f"draws of names that the equation does not have: {', '.join(ignored)}")
    thinned = draws if n_draws is None else thin_draws(draws, n_draws)
    return thinned.select("draw", *[F.col(c).cast("double").alias(c) for c in names]), names


def analyse_fixed_points(spark: SparkSession, equation: Equation, variable: str, low: float = -10.0, high: float = 10.0, points: int = 100, exogenous: dict[str, float] | None = None, coefficients: dict[str, float] | None = None, draws: DataFrame | None = None, n_draws: int | None = 200) -> DataFrame:
    """Fixed points of one equation, or of each draw (draw, a column per coefficient) of its coefficients."""
    drawn, names = _drawn(equation, draws, {*(coefficients or {})}, n_draws)
    ready = declared(equation, variable, exogenous, coefficients, names)
    grid = line(spark, low, high, points)
    if drawn is None:
        return fixed_points(grid.withColumn("k", F.lit(1)), Dynamics(ready, variable), ["k"]).drop("k").orderBy("fixed_point")
    keyed = drawn.crossJoin(F.broadcast(grid))  # ``points`` rows
    found = fixed_points(keyed, Dynamics(ready, variable), ["draw", *names])
    return found.drop(*names)


def analyse_bifurcations(spark: SparkSession, equation: Equation, variable: str, parameter: str, low: float, high: float, values: int = 50, z_low: float = -10.0, z_high: float = 10.0, points: int = 100, exogenous: dict[str, float] | None = None, draws: DataFrame | None = None, n_draws: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """Fixed points for every value of a parameter, and the status of each value: one plan over both grids.

    The parameter is a coefficient or another name of the equation. With ``draws`` the fixed
    points carry their draw and ``n_fixed_points`` counts those of all draws; ``consensus`` by
    the parameter sums them up. Status: ok, none (no root), or unevaluable (no finite value).
    """
    if parameter not in equation.names() or parameter == variable:
        raise UnknownName(f"{parameter} is no parameter of the equation")
    drawn, names = _drawn(equation, draws, {parameter}, n_draws)
    swept = declared(equation, variable, exogenous, None, (parameter, *names))
    parameters = line(spark, low, high, values, parameter)
    cells = line(spark, z_low, z_high, points).crossJoin(F.broadcast(parameters))  # points and values rows
    if drawn is not None:
        drawn = settled(drawn)
    grid = cells if drawn is None else drawn.crossJoin(F.broadcast(cells))
    f = Dynamics(swept, variable)
    found = fixed_points(grid, f, [parameter] if drawn is None else [parameter, "draw", *names]).drop(*names)
    if drawn is not None:
        found = settled(found)  # draws x values x points are searched once, however often the points are read
    finite_at = grid.groupBy(parameter).agg(F.count(finite(f(F.col("z")))).alias("_finite"))
    counts = found.groupBy(parameter).agg(F.count(F.lit(1)).alias("n_fixed_points"))
    status = parameters.join(finite_at, parameter, "left").join(counts, parameter, "left").withColumn("n_fixed_points", F.coalesce("n_fixed_points", F.lit(0)))
    named = F.when(F.col("n_fixed_points") > 0, "ok").when(F.col("_finite") > 0, "none").otherwise("unevaluable")
    return found, status.withColumn("status", named).drop("_finite")


def consensus(points: DataFrame, n_draws: int, interval: float = 0.9, keys: list[str] | None = None) -> DataFrame:
    """Branches of fixed points over posterior draws (draw, fixed_point, stability), for each of the keys.

    Draws with the most common number of points are used (the smaller number on a tie, draws
    without points included); the j-th point of each makes branch j, with median, interval, most
    common stability (first by name on a tie) and its share.
    """
    keys = keys or []
    counts = points.groupBy(*keys, "draw").agg(F.count(F.lit(1)).alias("m"))
    some = counts.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("freq"))
    none = counts.groupBy(*keys).agg((F.lit(n_draws) - F.count(F.lit(1))).alias("freq")).select(*keys, F.lit(0).cast("long").alias("m"), "freq")
    top = some.unionByName(none).groupBy(*keys).agg(F.max(F.struct("freq", (-F.col("m")).alias("m"))).alias("t"))
    modal = top.select(*keys, (-F.col("t.m")).alias("m"), F.col("t.freq").alias("freq"))
    kept = counts.join(modal, [*keys, "m"]).join(points, [*keys, "draw"])
    kept = kept.withColumn("branch", F.row_number().over(W.partitionBy(*keys, "draw").orderBy("fixed_point")))
    tail, by = (1 - interval) / 2, [*keys, "branch"]
    q = F.percentile("fixed_point", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    main = kept.groupBy(*by).agg(q.alias("q"), F.count(F.lit(1)).alias("n"), (F.first("freq") / n_draws).alias("prob_n_fixed_points"))
    shares = kept.groupBy(*by, "stability").agg(F.count(F.lit(1)).alias("c"))
    first = shares.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("c"), "stability"))).filter("_r = 1")
    out = main.join(first, by)
    return out.select(*by, F.element_at("q", 2).alias("fixed_point"), F.element_at("q", 1).alias("lower"), F.element_at("q", 3).alias("upper"), "stability", (F.col("c") / F.col("n")).alias("prob_stability"), "prob_n_fixed_points")
