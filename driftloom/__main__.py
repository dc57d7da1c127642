"""Command line: ``python -m driftloom data.csv target x1,x2`` searches for an equation and prints the front."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import search
from .sources import tables


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="driftloom")
    p.add_argument("data")
    p.add_argument("target")
    p.add_argument("predictors")
    p.add_argument("--complexity", type=int, default=30)
    p.add_argument("--iterations", type=int, default=30)
    p.add_argument("--parsimony", type=float, default=0.05)
    p.add_argument("--output")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    names = a.predictors.split(",")
    rows = spark.read.parquet(a.data) if a.data.endswith(".parquet") else tables.read_csv(spark, a.data)
    ready, counts = tables.prepare(rows, a.target, names)
    counts.show()
    front = search.pareto_front(search.genetic(ready, a.target, names, generations=a.iterations, penalty=a.parsimony, most_complexity=a.complexity))
    if a.output:
        front.write.mode("overwrite").parquet(a.output)
    front.orderBy("mse").show(5, truncate=False)


if __name__ == "__main__":
    main()
