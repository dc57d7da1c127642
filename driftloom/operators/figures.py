"""Tables behind pictures of residuals and fronts: bins, normal quantile pairs, flagged candidates."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shipping import shipped
from .search import select_equation


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Standard normal quantile of probabilities between 0 and 1."""
    return p.map(NormalDist().inv_cdf)


def finite(df: DataFrame, keys: list[str], value: str, *others: str) -> DataFrame:
    return df.select(*keys, F.col(value).cast("double").alias("_v"), *others).filter(F.abs("_v") < F.lit(float("inf")))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the bins of a histogram: low, high, count, density; empty bins between the ends are given too.

    About ceil(log2(n) + 1) bins (Sturges), of a width that is 1, 2 or 5 times a power of
    ten; bins hold their upper end, the first also its lower one, within 1e-7 of a width.
    Nulls and non-finite values are left out. A key with one value has one bin of width 1.
    """
    rows = finite(df, keys, value)
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).filter("_n > 0")
    s = s.withColumn("_cell", F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / F.ceil(F.log2(F.col("_n")) + 1)))
    s = s.withColumn("_base", F.pow(F.lit(10.0), F.floor(F.log10("_cell"))))
    cell, base = F.col("_cell"), F.col("_base")
    # A width gives way to the next when it is short of the cell by more than 1.5 (at five: 2.75) times what the next is over it.
    two, five, ten = 2 * base - cell < 1.5 * (cell - base), 5 * base - cell < 2.75 * (cell - 2 * base), 10 * base - cell < 1.5 * (cell - 5 * base)
    width = F.when(~two, base).when(~five, 2 * base).when(~ten, 5 * base).otherwise(10 * base)
    s = s.withColumn("_width", F.coalesce(F.when(cell > 0, width), F.lit(1.0)))
    s = s.withColumn("_first", F.floor(F.col("_low") / F.col("_width") + 1e-7) + 1)
    s = s.withColumn("_last", F.greatest(F.ceil(F.col("_high") / F.col("_width") - 1e-7), F.col("_first"))).drop("_cell", "_base")
    own = rows.join(s, keys) if keys else rows.crossJoin(F.broadcast(s))
    place = F.least(F.greatest(F.ceil(F.col("_v") / F.col("_width") - 1e-7), F.col("_first")), F.col("_last"))
    counts = own.groupBy(*keys, place.alias("_bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = s.withColumn("_bin", F.explode(F.sequence("_first", "_last"))).join(counts, [*keys, "_bin"], "left")
    count = F.coalesce("count", F.lit(0)).cast("long")
    return bins.select(*keys, (F.col("_bin") - F.col("_first") + 1).cast("int").alias("bin"), ((F.col("_bin") - 1) * F.col("_width")).alias("low"), (F.col("_bin") * F.col("_width")).alias("high"), count.alias("count"), (count / (F.col("_n") * F.col("_width"))).alias("density"))


def normal_pairs(df: DataFrame, keys: list[str], value: str, tie: str, parts: int = 32) -> DataFrame:
    """Per row its rank by value, plotting position p, normal quantile, and its value: rows (keys, tie, rank, n, p, theoretical, sample).

    Positions are (rank - a) / (n + 1 - 2a) with a = 3/8 for up to ten rows and 1/2 above;
    equal values rank by ``tie``. A key's rows are cut into ``parts`` at approximate
    quantiles and ranked within them, so no task sorts a large key whole (rows of one equal
    value stay together); where the cuts lie does not change ranks. Nulls and non-finite
    values are left out.
    """
    rows = finite(df, keys, value, F.col(tie).alias("_tie"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], F.lit(1000)).alias("_cuts"))
    cut = rows.join(cuts, keys) if keys else rows.crossJoin(F.broadcast(cuts))
    cut = cut.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    counts = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    by = [F.col(k) for k in keys] or [F.lit(1)]  # without keys there are at most ``parts`` rows here
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    places = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(*by)).alias("n"))
    ranked = cut.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_v", "_tie"))).join(F.broadcast(places) if not keys else places, [*keys, "_part"])
    a = F.when(F.col("n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    d = shipped(ranked).withColumn("rank", F.col("_before") + F.col("_r")).withColumn("p", (F.col("rank") - a) / (F.col("n") + 1 - 2 * a))
    return d.select(*keys, F.col("_tie").alias(tie), "rank", "n", "p", normal_quantile("p").alias("theoretical"), F.col("_v").alias("sample"))


def normal_line(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The line through both quartiles of ``normal_pairs``: slope and intercept per key."""
    sums = []
    for name, p in (("q1", 0.25), ("q3", 0.75)):
        h = (F.col("n") - 1) * p
        low = F.max(F.when(F.col("rank") == F.floor(h) + 1, F.col("sample")))
        high = F.max(F.when(F.col("rank") == F.ceil(h) + 1, F.col("sample")))
        part = F.max(h - F.floor(h))
        sums.append((low + part * (high - low)).alias(name))
    z = NormalDist().inv_cdf(0.75)
    q = pairs.groupBy(*keys).agg(*sums)
    return q.select(*keys, ((F.col("q3") - F.col("q1")) / (2 * z)).alias("slope"), ((F.col("q1") + F.col("q3")) / 2).alias("intercept"))


def front_table(front: DataFrame, results: DataFrame | None = None, highlight: str = "knee") -> DataFrame:
    """The front's rows (complexity, rmse, equation, on_front, is_selected), after them all other finite candidates if given."""
    chosen = select_equation(front, highlight).select("complexity", F.lit(True).alias("is_selected"))
    kept = front.join(F.broadcast(chosen), "complexity", "left").select("complexity", "rmse", "equation", F.lit(True).alias("on_front"), F.coalesce("is_selected", F.lit(False)).alias("is_selected"))
    if results is None:
        return kept
    others = results.join(front.select("complexity", "equation"), ["complexity", "equation"], "left_anti").withColumn("rmse", F.sqrt("mse")).filter(F.abs("rmse") < F.lit(float("inf")))
    return kept.unionByName(others.select("complexity", "rmse", "equation", F.lit(False).alias("on_front"), F.lit(False).alias("is_selected")))
