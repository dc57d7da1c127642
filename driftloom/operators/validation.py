"""Validation: folds, cross-validation, sensitivity, bootstrap, and choosing among iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.equations import Equation
from .panel import Panel, row_numbers
from .regression import least_squares

#: Rows of a series that the bootstrap keeps together; blocks that are longer make chunks of their length.
CHUNK = 1024


def block_folds(df: DataFrame, panel: Panel = Panel(), k: int = 5, block_size: int | None = None) -> DataFrame:
    """Add fold 1..k: equal-width bins of the row index, or blocks of ``block_size`` rows."""
    d = row_numbers(df, panel)
    if block_size:
        return d.withColumn("fold", (F.floor((F.col("rn") - 1) / block_size) + 1).cast("int"))
    return d.withColumn("fold", F.greatest(F.lit(1), F.ceil((F.col("rn") - 1) * k / F.nullif(F.col("n") - 1, F.lit(0)))).cast("int"))


def random_folds(df: DataFrame, panel: Panel = Panel(), k: int = 5, seed: int = 42) -> DataFrame:
    """Add fold 1..k by a hash of the row number: sizes differ by one at most, and reruns agree."""
    d = row_numbers(df, panel)
    shuffled = W.partitionBy(*panel.keys).orderBy(F.xxhash64("rn", F.lit(seed)), "rn")
    return d.withColumn("fold", ((F.row_number().over(shuffled) - 1) % k + 1).cast("int"))


def rolling_folds(df: DataFrame, panel: Panel = Panel(), k: int = 5, horizon: int = 1, train_size: int | None = None) -> DataFrame:
    """Rows with (fold, role): k test windows of ``horizon`` rows tile the end, training rows come before them."""
    folds = F.broadcast(df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("fold")))  # k rows
    start = F.col("n") - (k - F.col("fold") + 1) * horizon + 1
    d = row_numbers(df, panel).crossJoin(folds)
    first = start - train_size if train_size else F.lit(1)
    role = F.when((F.col("rn") >= start) & (F.col("rn") < start + horizon), "test").when((F.col("rn") < start) & (F.col("rn") >= first), "train")
    return d.withColumn("role", role).filter("role is not null")


def cv_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Means over folds and the pooled R^2 (ratio of sums)."""
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), (1 - F.sum("ss_res") / F.nullif(F.sum("ss_tot"), F.lit(0.0))).alias("r_squared_pooled"))


def select_iteration(scores: DataFrame, score: str = "score") -> DataFrame:
    """The iteration of the smallest finite score, the earliest among equals."""
    s = F.col(score)
    return scores.filter(~F.isnan(s) & (F.abs(s) < float("inf"))).orderBy(score, "iteration").limit(1)


def sensitivity(df: DataFrame, equation: Equation, percent: float = 10.0) -> DataFrame:
    """Rows (parameter, value, sensitivity, elasticity), most sensitive first.

    Every coefficient is moved up and down; the mean absolute change of the prediction per
    unit, and relative to the prediction, is one aggregation for all of them.
    """
    base, out = equation.column(), []
    for name, value in equation.coefficients.items():
        delta = abs(value) * percent / 100 if abs(value) > 1e-10 else 0.1
        up, down = (Equation(equation.text, equation.coefficients | {name: value + d}).column() for d in (delta, -delta))
        out += [F.avg(F.abs(up - down) / (2 * delta)).alias(f"s_{name}"), F.avg(F.abs((up - down) / F.nullif(base, F.lit(0.0))) / (2 * percent / 100)).alias(f"e_{name}")]
    s = df.agg(*out)
    rows = F.array(*[F.struct(F.lit(n).alias("parameter"), F.lit(float(v)).alias("value"), F.col(f"s_{n}").alias("sensitivity"), F.col(f"e_{n}").alias("elasticity")) for n, v in equation.coefficients.items()])
    return s.select(F.inline(rows)).orderBy(F.desc_nulls_last("sensitivity"))


def bootstrap(df: DataFrame, panel: Panel, target: Column, terms: dict[str, Column], replicates: int = 100, block: int | None = None, seed: int = 42) -> DataFrame:
    """Rows (keys, replicate, coefficients): least squares on series made of random blocks of rows.

    Block starts are hashes of replicate and block number, so reruns agree. Rows lie in chunks of at least
    a block's length, so a block is cut out of two chunks at most: a shuffle carries each row once and
    each block once or twice, never a row for each time that it is drawn.
    """
    d, keys = row_numbers(df, panel), [*panel.keys]
    size = F.lit(block) if block else F.greatest(F.lit(1), F.floor(F.sqrt("n")))
    length = F.greatest("_b", F.lit(CHUNK))
    d = d.withColumn("_b", size.cast("int")).withColumn("_chunk", F.floor((F.col("rn") - 1) / length))
    values = F.struct(F.col("rn").alias("_rn"), target.cast("double").alias("_y"), *[c.cast("double").alias(f"_t{i}") for i, c in enumerate(terms.values())])
    chunks = d.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(values)).alias("_rows"))
    draws = d.groupBy(*keys).agg(F.first("n").alias("n"), F.first("_b").alias("_b"))
    draws = draws.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("_b")) - 1).cast("int"))))
    start = F.pmod(F.xxhash64(*keys, "replicate", "_k", F.lit(seed)), F.col("n") - F.col("_b") + 1) + 1
    draws = draws.withColumn("_from", start.cast("int")).withColumn("_to", (F.col("_from") + F.least(F.col("_b"), F.col("n") - F.col("_k") * F.col("_b")) - 1).cast("int"))
    ends = [F.floor((F.col(c) - 1) / length) for c in ("_from", "_to")]
    draws = draws.select(*keys, "replicate", "_from", "_to", F.explode(F.array_distinct(F.array(*ends))).alias("_chunk"))
    # Both sides are shuffled: tables grown by explode look small to the planner, which broadcast them.
    met = chunks.hint("merge").join(draws, [*keys, "_chunk"])
    first = F.greatest("_from", F.get("_rows", F.lit(0))["_rn"])
    part = F.slice("_rows", (first - F.get("_rows", F.lit(0))["_rn"] + 1).cast("int"), (F.col("_to") - first + 1).cast("int"))
    drawn = met.select(*keys, "replicate", F.inline(part))
    return least_squares(drawn, [*keys, "replicate"], F.col("_y"), {name: F.col(f"_t{i}") for i, name in enumerate(terms)})
