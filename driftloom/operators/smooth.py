"""Sums of smooth functions of predictors: penalised B-splines whose products are aggregated cell by cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import shipped

# Row k: what powers 0 to 3 of the place in a cell count in the k-th of the four cubic B-splines there.
BASIS = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0
LEAST, MOST = -6.0, 8.0


def additive(df: DataFrame, keys: list[str], target: Column, predictors: list[str], weight: Column | None = None, pieces: int = 10) -> DataFrame:
    """``target`` as an intercept and one smooth function of each predictor, one fit per key.

    A smooth is a cubic B-spline of ``pieces`` equal cells over its predictor's range, with a
    penalty on second differences of its coefficients; the penalties, one for each smooth,
    minimise generalised cross-validation. Rows are added up by the cells of two predictors,
    as sums of powers of their places in the cells; only these sums, at most pieces^2 rows
    for a pair of predictors, reach a key's solve.

    Rows with a null or non-finite value are left out, and a key without other rows has no
    fit. A predictor with one value has a smooth of zero; too few rows for a curve give
    lines. Returns keys, n, edf (intercept included), gcv, rss, tss, intercept, and by
    predictor lows, steps, penalties and coefficients.
    """
    if not predictors or pieces < 1:
        raise ValueError("additive fits need a predictor and at least one cell")
    p = len(predictors)
    x = [f"_x{i}" for i in range(p)]
    rows = df.select(*keys, target.cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"), *[F.col(c).cast("double").alias(n) for c, n in zip(predictors, x, strict=True)])
    for c in ("_y", "_w", *x):
        rows = rows.filter(F.abs(c) < F.lit(float("inf")))
    ends = rows.groupBy(*keys).agg(F.avg("_y").alias("_centre"), *[F.struct(F.min(c).alias("low"), ((F.max(c) - F.min(c)) / pieces).alias("step")).alias(f"_r{i}") for i, c in enumerate(x)])
    near = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))
    places = [F.when(F.col(f"_r{i}.step") > 0, (F.col(c) - F.col(f"_r{i}.low")) / F.col(f"_r{i}.step")).otherwise(F.lit(0.0)) for i, c in enumerate(x)]
    cells = [F.least(F.floor(c), F.lit(pieces - 1)) for c in places]
    near = near.select(*keys, "_centre", *[f"_r{i}" for i in range(p)], "_w", (F.col("_y") - F.col("_centre")).alias("_y"), *[c.cast("int").alias(f"_c{i}") for i, c in enumerate(cells)], *[(a - b).alias(f"_u{i}") for i, (a, b) in enumerate(zip(places, cells, strict=True))])
    pairs = F.array(*[F.struct(F.lit(i).alias("_a"), F.lit(j).alias("_b"), F.col(f"_c{i}").alias("_ca"), F.col(f"_c{j}").alias("_cb"), F.col(f"_u{i}").alias("_ua"), F.col(f"_u{j}").alias("_ub")) for i in range(p) for j in range(i, p)])
    spread = near.select(*keys, "_centre", *[f"_r{i}" for i in range(p)], "_w", "_y", F.inline(pairs))

    def power(c: str, k: int) -> Column:
        out = F.lit(1.0)
        for _ in range(k):
            out = out * F.col(c)
        return out

    w, y = F.col("_w"), F.col("_y")
    sums = spread.groupBy(*keys, "_a", "_b", "_ca", "_cb").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("_centre").alias("_centre"),
        F.array(*[F.first(f"_r{i}.low") for i in range(p)]).alias("_lows"),
        F.array(*[F.first(f"_r{i}.step") for i in range(p)]).alias("_steps"),
        F.sum(w * y * y).alias("_yy"),
        F.array(*[F.sum(w * y * power("_ua", k)) for k in range(4)]).alias("_yu"),
        F.array(*[F.sum(w * power("_ua", i) * power("_ub", j)) for i in range(4) for j in range(4)]).alias("_uu"),
    )

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return fit_of(part, keys, p, pieces)

    numbers = "n long, edf double, gcv double, rss double, tss double, intercept double, lows array<double>, steps array<double>, penalties array<double>, coefficients array<array<double>>"
    schema = StructType(df.select(*keys).schema.fields + StructType.fromDDL(numbers).fields)
    # By a number of partitions: few bytes are much work, which adaptive execution would put into one task.
    dealt = sums.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *keys) if keys else sums
    return shipped(dealt).groupBy(*keys).applyInPandas(one, schema)


def fit_of(part: pd.DataFrame, keys: list[str], p: int, pieces: int) -> pd.DataFrame:
    """The row of ``additive`` for one key, from its sums by cells."""
    q = pieces + 3
    gram, right = np.zeros((p * q, p * q)), np.zeros(p * q)
    at, blocks = part[["_a", "_b", "_ca", "_cb"]].to_numpy(int), BASIS @ np.stack(part["_uu"]).reshape(-1, 4, 4) @ BASIS.T
    rights = np.stack(part["_yu"]) @ BASIS.T
    for (i, j, ca, cb), block, add in zip(at.tolist(), blocks, rights, strict=True):
        a, b = i * q + ca, j * q + cb
        gram[a : a + 4, b : b + 4] += block
        if i != j:
            gram[b : b + 4, a : a + 4] += block.T
        else:
            right[a : a + 4] += add
    own = part[(part._a == 0) & (part._b == 0)]
    n, mass = int(own._n.sum()), float(gram[:q, :q].sum())
    shift, total = float(sum(u[0] for u in own._yu)), float(own._yy.sum())
    first = part.iloc[0]
    lows, steps = np.asarray(first._lows, float), np.asarray(first._steps, float)
    column = np.concatenate([gram[i * q : (i + 1) * q, i * q : (i + 1) * q].sum(axis=1) for i in range(p)])
    # An intercept takes the means out; what is left of each smooth is determined but for a constant.
    gram, right, tss = gram - np.outer(column, column) / mass, right - column * shift / mass, max(total - shift * shift / mass, 0.0)
    used = [i for i in range(p) if steps[i] > 0]
    free = np.linalg.svd(np.ones((1, q)))[2][1:].T
    turn = np.diff(np.eye(q), 2, axis=0)
    rough = free.T @ turn.T @ turn @ free
    z = np.zeros((p * q, len(used) * (q - 1)))
    for k, i in enumerate(used):
        z[i * q : (i + 1) * q, k * (q - 1) : (k + 1) * (q - 1)] = free
    g, h = z.T @ gram @ z, z.T @ right
    parts = [slice(k * (q - 1), (k + 1) * (q - 1)) for k in range(len(used))]
    unit = [np.trace(g[s, s]) / np.trace(rough) for s in parts]

    def at(logs: tuple[float, ...]) -> tuple[float, float, float, np.ndarray]:
        system = g.copy()
        for s, u, e in zip(parts, unit, logs, strict=True):
            system[s, s] += u * 10.0**e * rough
        # The pseudo-inverse by eigenvectors, without what numpy's own does besides.
        size, v = np.linalg.eigh(system)
        big = np.abs(size) > 1e-13 * np.abs(size).max(initial=0.0)
        v = v[:, big]
        inverse = (v / size[big]) @ v.T
        b = inverse @ h
        edf, rss = 1 + float(np.sum(inverse * g)), max(float(tss - 2 * b @ h + b @ g @ b), 0.0)
        return (n * rss / (n - edf) ** 2 if n - edf > 1e-6 else np.inf), edf, rss, b

    common = [tuple([e] * len(used)) for e in np.arange(MOST, LEAST - 1, -1.0)]
    best = min(((at(c), c) for c in common), key=lambda found: found[0][0])
    step = 0.5
    while used and step > 0.01:
        better = False
        for k in range(len(used)):
            for way in (step, -step):
                trial = list(best[1])
                trial[k] = min(max(trial[k] + way, LEAST), MOST)
                got = at(tuple(trial))
                if got[0] < best[0][0] * (1 - 1e-12):
                    best, better = (got, tuple(trial)), True
        step = step if better else step / 2
    (gcv, edf, rss, b), logs = best
    beta = (z @ b).reshape(p, q) if used else np.zeros((p, q))
    penalties = np.zeros(p)
    for i, u, e in zip(used, unit, logs, strict=True):
        penalties[i] = u * 10.0**e
    found = {"n": n, "edf": edf, "gcv": gcv if np.isfinite(gcv) else None, "rss": rss, "tss": tss}
    found |= {"intercept": float(first._centre) + (shift - column @ beta.ravel()) / mass}
    found |= {"lows": lows.tolist(), "steps": steps.tolist(), "penalties": penalties.tolist(), "coefficients": beta.tolist()}
    return pd.DataFrame([{k: first[k] for k in keys} | found])


def predict_additive(df: DataFrame, fits: DataFrame, keys: list[str], predictors: list[str], out: str = "prediction") -> DataFrame:
    """``df`` with what ``additive`` fits give for each row; lines go on beyond a predictor's range.

    Null where a predictor is null or the key has no fit.
    """
    fit = fits.select(*keys, F.struct("intercept", "lows", "steps", "coefficients").alias("_fit"))
    d = df.join(fit, keys, "left") if keys else df.join(F.broadcast(fit), how="left")
    # Each step is a projection of its own: as one expression it outgrows compiled code.
    step = [F.col("_fit.steps")[i] for i in range(len(predictors))]
    last = [F.size(F.col("_fit.coefficients")[i]) - 3 for i in range(len(predictors))]
    d = d.withColumns({f"_p{i}": (F.col(name).cast("double") - F.col("_fit.lows")[i]) / F.nullif(step[i], F.lit(0.0)) for i, name in enumerate(predictors)})
    d = d.withColumns({f"_i{i}": F.least(F.greatest(f"_p{i}", F.lit(0.0)), last[i].cast("double")) for i in range(len(predictors))})
    d = d.withColumns({f"_c{i}": F.least(F.floor(f"_i{i}"), last[i] - 1).cast("int") for i in range(len(predictors))})
    d = d.withColumns({f"_b{i}": F.slice(F.col("_fit.coefficients")[i], F.col(f"_c{i}") + 1, F.lit(4)) for i in range(len(predictors))})
    d = d.withColumns({f"_m{i}": F.array(*[sum((F.col(f"_b{i}")[k] * float(BASIS[k, m]) for k in range(1, 4)), F.col(f"_b{i}")[0] * float(BASIS[0, m])) for m in range(4)]) for i in range(len(predictors))})
    total = F.col("_fit.intercept")
    for i, name in enumerate(predictors):
        u, m = F.col(f"_i{i}") - F.col(f"_c{i}"), [F.col(f"_m{i}")[k] for k in range(4)]
        beyond = (F.col(f"_p{i}") - F.col(f"_i{i}")) * (m[1] + u * (2 * m[2] + u * 3 * m[3]))
        total = total + F.when(step[i] > 0, m[0] + u * (m[1] + u * (m[2] + u * m[3])) + beyond).when(F.col(name).isNotNull(), F.lit(0.0))
    return d.withColumn(out, total).drop("_fit", *[f"_{c}{i}" for c in "picbm" for i in range(len(predictors))])
