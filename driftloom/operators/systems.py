"""Simulation of coupled equations: many parameter sets, several state variables, shared and correlated noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.equations import Equation
from ..functions.errors import NameCollision, UndeclaredName
from ..shipping import shipped

#: Paths of a task that move together, and rows of one output batch.
PATHS, ROWS = 4096, 50_000


def scrambled(x: np.ndarray) -> np.ndarray:
    """64 bits that look random for each 64-bit counter (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normals(path: np.ndarray, increment: int, source: int) -> np.ndarray:
    """A standard normal for every path, by the number of the increment and of the noise source alone."""
    at = scrambled(scrambled(path + np.uint64(2 * increment + 1) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(source))
    u, v = ((scrambled(at + np.uint64(i)) >> np.uint64(11)).astype(float) + 0.5 for i in (1, 2))
    return np.sqrt(-2 * np.log(u / 2**53)) * np.cos(2 * np.pi * v / 2**53)


def simulate_system(
    starts: DataFrame,
    keys: list[str],
    drift: dict[str, Equation],
    step: float,
    steps: int,
    noise: dict[str, dict[str, Equation]] | None = None,
    correlation: dict[tuple[str, str], float] | None = None,
    sims: int = 1,
    method: str = "euler",
    increments: int = 1,
    seed: int = 42,
    first: int = 0,
) -> DataFrame:
    """Rows (keys, sim, step, t, variables): paths of dx = f(x, t) dt + G(x, t) dW for every row of ``starts``.

    ``starts`` has a row per key with the first value of every variable of ``drift`` and a column
    for every other name in the equations, so each key has its own parameters, as from a table of
    fits; ``t`` in an equation is the time since the start. ``noise`` gives, by variable, loadings
    on named sources of noise: a source under several variables moves them together, and
    ``correlation`` ties sources to each other. Methods: euler, or rk4 for the drift, with
    the noise of a step taken at its start.

    Noise depends on (seed, keys, sim, increment, source) alone, not on partitions. A step's noise is the
    sum of ``increments`` finer ones, so step h of one increment and step 4 h of four see the same
    Brownian path. From where a path leaves the finite numbers on its variables are null, as
    they are where a start or parameter is null. Tasks move blocks of paths together and
    hand over rows as they go; no path is held whole. Rows before step ``first`` are not handed
    over: with ``first=steps`` a path gives its end alone.
    """
    variables, noise = list(drift), noise or {}
    sources = sorted({s for v in noise.values() for s in v})
    loadings = [e for v in noise.values() for e in v.values()]
    known = {*starts.columns, "t"}
    taken = sorted({"sim", "step", "t"} & {*keys, *variables})
    if taken:
        raise NameCollision(f"{', '.join(taken)}: names of the result")
    absent = [v for v in variables if v not in starts.columns] + [v for v in noise if v not in variables] + sorted({n for e in (*drift.values(), *loadings) for n in e.free(list(known))})
    if absent:
        raise UndeclaredName(f"no value for {', '.join(dict.fromkeys(absent))}")
    if method not in ("euler", "rk4"):
        raise ValueError(f"method is euler or rk4, not {method}")
    ties = np.eye(len(sources))
    for (a, b), c in (correlation or {}).items():
        ties[sources.index(a), sources.index(b)] = ties[sources.index(b), sources.index(a)] = c
    mixing = np.linalg.cholesky(ties) if sources else ties  # fails where the correlations contradict each other
    others = [c for c in starts.columns if c not in (*keys, *variables)]
    used = [c for c in others if any(c in e.free([]) for e in (*drift.values(), *loadings))]
    fine = (step / increments) ** 0.5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at_row in range(0, len(whole), PATHS):
                b = whole.iloc[at_row : at_row + PATHS]
                given = {c: b[c].to_numpy(float) for c in used}
                path = b["_path"].to_numpy(np.int64).astype(np.uint64)
                state = [b[v].to_numpy(float) for v in variables]
                for column in given.values():
                    state = [np.where(np.isnan(column), np.nan, x) for x in state]

                def at(equation: Equation, x: list[np.ndarray], t: float) -> np.ndarray:
                    return np.broadcast_to(equation.values({**given, **dict(zip(variables, x, strict=True)), "t": np.full(len(b), t)}), len(b))

                def slope(x: list[np.ndarray], t: float) -> list[np.ndarray]:
                    return [at(e, x, t) for e in drift.values()]

                def moved(x: list[np.ndarray], by: list[np.ndarray], h: float) -> list[np.ndarray]:
                    return [p + h * q for p, q in zip(x, by, strict=True)]

                held: list[pd.DataFrame] = []
                for i in range(steps + 1):
                    if i:
                        t = (i - 1) * step
                        with np.errstate(all="ignore"):
                            k1 = slope(state, t)
                            if method == "rk4":
                                k2 = slope(moved(state, k1, step / 2), t + step / 2)
                                k3 = slope(moved(state, k2, step / 2), t + step / 2)
                                k4 = slope(moved(state, k3, step), t + step)
                                k1 = [(p + 2 * q + 2 * r + s) / 6 for p, q, r, s in zip(k1, k2, k3, k4, strict=True)]
                            new = moved(state, k1, step)
                            if sources:
                                plain = [sum(normals(path, (i - 1) * increments + j, s) for j in range(increments)) * fine for s in range(len(sources))]
                                tied = mixing @ np.array(plain)
                                for n, v in enumerate(variables):
                                    for source, loading in noise.get(v, {}).items():
                                        new[n] = new[n] + at(loading, state, t) * tied[sources.index(source)]
                            good = np.all([np.isfinite(x) for x in new], axis=0)
                            state = [np.where(good, x, np.nan) for x in new]
                    if i < first:
                        continue
                    held.append(b[[*keys, "sim"]].assign(step=i, t=i * step, **dict(zip(variables, state, strict=True))))
                    if len(held) * len(b) >= ROWS:
                        yield pd.concat(held)
                        held = []
                if held:
                    yield pd.concat(held)

    # By a number of partitions: a few bytes of starts are much work, which adaptive execution would put into one task.
    dealt = starts.repartition(4 * starts.sparkSession.sparkContext.defaultParallelism, *keys) if keys else starts
    paths = dealt.select(*keys, *[F.col(c).cast("double").alias(c) for c in (*variables, *used)], F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim"))
    paths = paths.withColumn("_path", F.xxhash64(F.lit(seed), *keys, "sim"))
    types = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in starts.select(*keys).schema), "sim int", "step int", "t double", *(f"`{v}` double" for v in variables)]
    out = shipped(paths).mapInPandas(run, ", ".join(types))
    return out.select(*keys, "sim", "step", "t", *[F.when(~F.isnan(F.col(f"`{v}`")), F.col(f"`{v}`")).alias(v) for v in variables])
