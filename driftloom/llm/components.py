"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def skewed_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` so that adaptive execution can split a hot key of ``big``.

    The join key is an expression of ``key`` that no earlier aggregation is partitioned by,
    so both sides are shuffled for the join alone.
    """
    other = small.withColumnRenamed(key, "_key")
    return big.join(other, F.col(key).bitwiseXOR(F.lit(1)) == F.col("_key").bitwiseXOR(F.lit(1)), how).drop("_key")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (u, v: long): the smallest node reachable.

    Alternates large-star and small-star steps: each node's larger neighbours, then its
    smaller ones, are attached to the smallest node known, until nothing changes. Every
    round is written to the shared folder. Nodes without edges are not in the result.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(skewed_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skewed_join(large, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
