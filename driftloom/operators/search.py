"""Search for equations: exhaustive and genetic candidates, Pareto fronts and selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.equations import NUMBER, Equation, structure
from ..functions.scalars import inverse, ln
from ..shipping import shipped
from .lineage import settled
from .regression import centred_moments, moment_arrays, solve_centred
from .windows import rising_minimum

# Physical and mathematical constants that fitted numbers are compared with.
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045, "phi": 1.618033988749895, "g": 9.80665, "c": 299792458.0, "h": 6.62607015e-34, "k_B": 1.380649e-23}

#: Rows on which a task scores all candidates at once.
BLOCK = 4096


def pareto_front(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Candidates (complexity, mse, equation) that no simpler one of their ``keys`` equals in error, with rmse."""
    front = rising_minimum(results, ["complexity", "mse", "equation"], "mse", keys)
    return front.withColumn("rmse", F.sqrt("mse")).select(*(keys or []), "complexity", "mse", "rmse", "equation")


def best_by_complexity(results: DataFrame) -> DataFrame:
    """The candidate of least error for each complexity; the first by text among equals."""
    w = W.partitionBy("complexity").orderBy("mse", "equation")
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def knee(front: DataFrame, x: str = "complexity", y: str = "mse") -> DataFrame:
    """The front's point farthest from the chord between its ends, both axes scaled to 0..1; the first among equals."""
    every, line = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy(x, y)
    u = (F.col(x) - F.min(x).over(every)) / (F.max(x).over(every) - F.min(x).over(every) + 1e-10)
    v = (F.col(y) - F.min(y).over(every)) / (F.max(y).over(every) - F.min(y).over(every) + 1e-10)
    d = front.withColumn("_u", u).withColumn("_v", v).withColumn("_i", F.row_number().over(line))
    ends = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for c in ("_u", "_v"):
        d = d.withColumn(f"{c}1", F.first(c).over(ends)).withColumn(f"{c}2", F.last(c).over(ends))
    du, dv = F.col("_u2") - F.col("_u1"), F.col("_v2") - F.col("_v1")
    gap = F.abs(dv * F.col("_u") - du * F.col("_v") + F.col("_u2") * F.col("_v1") - F.col("_v2") * F.col("_u1")) / F.nullif(F.sqrt(du * du + dv * dv), F.lit(0.0))
    return d.withColumn("distance", F.coalesce(gap, F.lit(0.0))).orderBy(F.desc(F.round("distance", 12)), "_i").limit(1).select(*front.columns, "distance")


def select_equation(front: DataFrame, criterion: str = "knee", n: int = 100) -> DataFrame:
    """One row of the front: knee, BIC, AIC, min_complexity or min_error, ties to the simplest."""
    if criterion == "knee":
        return knee(front).drop("distance")
    k, fit = F.col("complexity"), n * F.ln("mse")
    score = {"BIC": fit + k * float(np.log(n)), "AIC": fit + 2 * k, "min_complexity": k.cast("double"), "min_error": F.col("mse")}[criterion]
    return front.withColumn("_s", score).orderBy("_s", "complexity", "equation").limit(1).drop("_s")


def match_back(front: DataFrame, results: DataFrame, order: str = "equation", tolerance: float = 1e-10) -> DataFrame:
    """``front`` with ``record``: the first of all ``results`` (by ``order``) of equal complexity whose mse is within ``tolerance``; null if none is.

    Errors are joined by their multiple of the tolerance and both neighbouring ones, so no
    range is compared row by row.
    """
    step = F.rint(F.col("mse") / tolerance)
    f = front.select("complexity", F.col("mse").alias("_mse"), F.explode(F.array_distinct(F.array(step - 1, step, step + 1))).alias("_step")).distinct()
    named = results.select("complexity", step.alias("_step"), F.col("mse").alias("_own"), F.col(order).alias("_order"), F.struct(*results.columns).alias("_record"))
    met = named.join(f, ["complexity", "_step"]).filter((F.abs(F.col("_own") - F.col("_mse")) < tolerance) | (F.col("_own") == F.col("_mse")))
    first = met.groupBy("complexity", F.col("_mse").alias("mse")).agg(F.min_by("_record", "_order").alias("record"))
    return front.join(first, ["complexity", "mse"], "left").select(*front.columns, "record")


def front_scores(df: DataFrame, target: str, equations: list[Equation]) -> DataFrame:
    """Per equation complexity, mse, mae, r_squared, structure and number of constants, by complexity, from one pass over the rows.

    r_squared is clamped to -1..1, and 0 where the target's sum of squares is at most 1e-10.
    Rows with a null in the target or a variable are left out; equations with a non-finite
    error are skipped, and all are when no row is left.
    """
    used = sorted({v for e in equations for v in e.variables(df.columns)} | {target})
    y = F.col(target).cast("double")
    gaps = [y - e.column() for e in equations]
    sums = [c for i, g in enumerate(gaps) for c in (F.avg(g * g).alias(f"s{i}"), F.avg(F.abs(g)).alias(f"a{i}"))]
    got = df.dropna(subset=used).agg(F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("v"), *sums).first()
    out = []
    for i, e in enumerate(equations):
        mse, mae = got[f"s{i}"], got[f"a{i}"]
        if mse is None or not np.isfinite(mse) or not np.isfinite(mae):
            continue
        r2 = 1 - mse / got["v"] if got["n"] * got["v"] > 1e-10 else 0.0
        out.append((e.complexity(), mse, mae, min(max(r2, -1.0), 1.0), e.text, NUMBER.sub("C", e.text), len(NUMBER.findall(e.text))))
    return df.sparkSession.createDataFrame(sorted(out), "complexity int, mse double, mae double, r_squared double, equation string, structure string, n_constants int")


def library(predictors: list[str]) -> tuple[dict[str, Column], list[tuple[int, list[str]]]]:
    """Terms by name, and forms (complexity, terms): a line in each predictor, its inverse, square and log, and in pairs.

    A product of a pair comes with both its main effects.
    """
    terms: dict[str, Column] = {}
    forms: list[tuple[int, list[str]]] = []
    for p in predictors:
        c = F.col(p).cast("double")
        terms |= {p: c, f"inv({p})": inverse(c), f"square({p})": c * c, f"log(abs({p}) + 1e-10)": ln(F.abs(c) + 1e-10)}
        forms += [(1, [p]), (2, [f"inv({p})"]), (2, [f"square({p})"]), (2, [f"log(abs({p}) + 1e-10)"])]
    for i, p in enumerate(predictors):
        for q in predictors[i + 1 :]:
            terms[f"{p} * {q}"] = F.col(p).cast("double") * F.col(q)
            forms += [(3, [p, q]), (3, [p, q, f"{p} * {q}"])]
    return terms, forms


def exhaustive(df: DataFrame, target: str, predictors: list[str], weight: Column | None = None) -> DataFrame:
    """Rows (complexity, equation, mse) of all forms of ``library``.

    All candidates share one pass over the data for their sums of products; text carries
    the fitted numbers. Candidates that are not finite on every row, or whose terms are not
    independent, are left out.
    """
    terms, forms = library(predictors)
    names = list(terms)
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in (target, *predictors)))
    # One row of centred sums for all candidates; each candidate solves its block of them.
    got = centred_moments(rows, [], [F.col(target), *terms.values()], weight).toPandas()
    (mean,), (sums,) = moment_arrays(got, len(names) + 1)
    n, mass, out = int(got["n"][0]), float(got["mass"][0] or 0), []
    for complexity, used in forms:
        at = [0, *(names.index(u) + 1 for u in used)]
        solved = solve_centred(mean[at], sums[np.ix_(at, at)]) if n else None
        if solved is None:
            continue
        beta, _, rss = solved
        text = " + ".join([f"{beta[0]:.10g}", *(f"{b:.10g} * {u}" for b, u in zip(beta[1:], used, strict=True))])
        out.append((complexity, " + ".join(used), text, rss / mass))
    return df.sparkSession.createDataFrame(out, "complexity int, form string, equation string, mse double")


def ensemble(results: DataFrame) -> DataFrame:
    """Candidates of several runs grouped by structure: mean and sd of loss, count, and consistency, best first."""
    g = results.withColumn("structure", structure(F.col("equation"))).groupBy("structure")
    s = g.agg(F.min("complexity").alias("complexity"), F.avg("mse").alias("mean_loss"), F.stddev_samp("mse").alias("std_loss"), F.min("equation").alias("equation"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("consistency", F.col("n") / (1 + F.coalesce("std_loss", F.lit(0.0)))).orderBy(F.desc("consistency"), "structure")


def detect_constants(values: DataFrame, value: str = "value", rtol: float = 0.01) -> DataFrame:
    """Rows (value, label): known constants, their double, half, square, inverse and fourfold within ``rtol``."""
    spark = values.sparkSession
    known = [(n + s, v) for n, c in CONSTANTS.items() for s, v in (("", c), ("*2", 2 * c), ("/2", c / 2), ("^2", c * c), ("^-1", 1 / c), ("*4", 4 * c))]
    table = F.broadcast(spark.createDataFrame(known, "label string, known double"))  # a few dozen rows
    v = F.abs(F.col(value))
    return values.join(table, F.abs(v - F.col("known")) <= rtol * F.greatest(v, F.abs("known"))).select(value, "label").distinct()


class Genome:
    """Random expression trees as nested tuples, for the genetic search inside one task."""

    UNARY = ("inv", "square", "sqrt", "log", "exp")

    def __init__(self, rng: np.random.Generator, names: list[str]) -> None:
        self.rng, self.names = rng, names

    def tree(self, depth: int) -> tuple:
        r = self.rng
        if depth <= 0 or r.random() < 0.3:
            return ("var", str(r.choice(self.names))) if r.random() < 0.5 else ("num", float(np.round(r.uniform(-5, 5), 4)))
        if r.random() < 0.3:
            return (str(r.choice(self.UNARY)), self.tree(depth - 1))
        return (str(r.choice(["+", "-", "*", "/"])), self.tree(depth - 1), self.tree(depth - 1))

    def mutate(self, t: tuple, depth: int = 3) -> tuple:
        r = self.rng
        if r.random() < 0.3:
            return self.tree(depth)
        if t[0] == "num":
            return ("num", float(np.round(t[1] + r.normal(0, 0.5), 4)))
        if t[0] == "var":
            return ("var", str(r.choice(self.names)))
        i = int(r.integers(1, len(t)))
        return (*t[:i], self.mutate(t[i], depth - 1), *t[i + 1 :])

    def cross(self, a: tuple, b: tuple) -> tuple:
        if a[0] in "+-*/" and len(a) == 3:
            return (a[0], a[1], b) if self.rng.random() < 0.5 else (a[0], b, a[2])
        return b


def size(t: tuple) -> int:
    return 1 if t[0] in ("num", "var") else 1 + sum(map(size, t[1:]))


def spelled(t: tuple) -> str:
    """Text of a tree with its operations protected against undefined values, as they were scored."""
    match t:
        case ("num", v):
            return f"{v:.4f}" if v >= 0 else f"(-{-v:.4f})"
        case ("var", n):
            return n
        case (("+" | "-" | "*") as op, a, b):
            return f"({spelled(a)} {op} {spelled(b)})"
        case ("/", a, b):
            return f"({spelled(a)} / ({spelled(b)} + sign({spelled(b)}) * 1e-10))"
        case ("inv", a):
            return f"(1 / ({spelled(a)} + sign({spelled(a)}) * 1e-10))"
        case ("sqrt", a):
            return f"sqrt(abs({spelled(a)}))"
        case ("log", a):
            return f"log(abs({spelled(a)}) + 1e-10)"
        case (f, a):
            return f"{f}({spelled(a)})"


def errors(df: DataFrame, target: str, equations: list[str]) -> list[float]:
    """Mean squared error of every equation over all rows of ``df``; infinite where it is not finite.

    One pass: tasks add up squared errors of their rows for all equations, block by block.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, read = np.zeros(len(equations)), 0, [Equation(text) for text in equations]
        for b in batches:
            n += len(b)
            for at in range(0, len(b), BLOCK):
                data = {c: b[c].to_numpy(float)[at : at + BLOCK] for c in b.columns}
                known: dict[str, np.ndarray] = {}  # candidates are bred from each other and share many parts
                with np.errstate(all="ignore"):
                    for i, e in enumerate(read):
                        gap = e.values(data, known) - data[target]
                        total[i] += float(np.sum(np.broadcast_to(gap, len(data[target])) ** 2))
        # NaN would turn into null on its way, and the sum over tasks would leave this task's rows out.
        yield pd.DataFrame({"i": np.arange(len(equations)), "sse": np.where(np.isnan(total), np.inf, total), "n": n})

    got = shipped(df).mapInPandas(add, "i int, sse double, n long").groupBy("i").agg((F.sum("sse") / F.nullif(F.sum("n"), F.lit(0))).alias("mse")).collect()
    out = [np.inf] * len(equations)
    for r in got:
        if r.mse is not None and np.isfinite(r.mse):
            out[r.i] = float(f"{r.mse:.11g}")  # last digits depend on how rows are dealt, and a search would follow them
    return out


def genetic(df: DataFrame, target: str, predictors: list[str], runs: int = 5, population: int = 100, generations: int = 50, penalty: float = 0.05, most_complexity: int = 30, seed: int = 42) -> DataFrame:
    """Rows (run_id, complexity, mse, equation) of the last populations of independent genetic searches.

    Every generation of all runs is scored over all rows in one Spark job; populations, a
    few hundred texts, are bred here. Rows with a null in any of the columns are left out.
    """
    spark, columns = df.sparkSession, [target, *predictors]
    rows = df.select(*[F.col(c).cast("double") for c in columns]).dropna()
    # Written once for all generations, in parts for all cores: few bytes are much work.
    rows = settled(rows.repartition(4 * spark.sparkContext.defaultParallelism))
    makers = [Genome(np.random.default_rng(seed + 1000 * run), predictors) for run in range(runs)]
    pools = [[m.tree(4) for _ in range(population)] for m in makers]
    known: dict[str, float] = {}

    def learn() -> None:
        texts = sorted({spelled(t) for pool in pools for t in pool if size(t) <= most_complexity} - known.keys())
        if texts:
            known.update(zip(texts, errors(rows, target, texts), strict=True))

    def score(t: tuple) -> float:
        return known.get(spelled(t), np.inf) + penalty * size(t)

    for _ in range(generations):
        learn()
        for run, (maker, pool) in enumerate(zip(makers, pools, strict=True)):
            order, rng = sorted(pool, key=score), maker.rng
            children = [order[0]]
            while len(children) < population:
                first = order[int(min(rng.integers(0, population, 3)))]
                child = maker.cross(first, order[int(min(rng.integers(0, population, 3)))]) if rng.random() < 0.7 else first
                children.append(maker.mutate(child) if rng.random() < 0.3 else child)
            pools[run] = children
    learn()
    found = {(run, spelled(t)): size(t) for run, pool in enumerate(pools) for t in pool}
    good = [(run, n, known[text], text) for (run, text), n in sorted(found.items()) if np.isfinite(known.get(text, np.inf))]
    return spark.createDataFrame(good, "run_id int, complexity int, mse double, equation string")
