"""Sources: tables, series files, example series, and the checks before an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite
from ..operators.panel import TIME_NAMES

# Texts that stand for a missing number, and date formats that are tried in order.
NULL_TOKENS = ("NA", "NaN", "", "null", ".", "NULL", "N/A")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy")

#: Example series: their variables, and (rate equations, start, step, steps) that make them.
EXAMPLES: dict[str, tuple[str, tuple]] = {
    "logistic_growth": ("Z", (("0.8 * Z * (1 - Z / 10)",), (1.0,), 0.1, 50)),
    "predator_prey": ("X, Y", (("1.1 * X - 0.4 * X * Y", "0.1 * X * Y - 0.4 * Y"), (10.0, 5.0), 0.2, 40)),
    "interest_rate": ("rate", (("0.5 * (0.05 - rate)",), (0.03,), 0.04, 50)),
    "epidemic_data": ("S, I, R", (("-0.4 * S * I / 1000", "0.4 * S * I / 1000 - 0.1 * I", "0.1 * I"), (990.0, 10.0, 0.0), 1.0, 20)),
    "oscillator_data": ("x, y", (("y", "(1 - x^2) * y - x"), (2.0, 0.0), 0.2, 40)),
    "business_cycle": ("Y, K", (("0.3 * (120 - Y) - 0.05 * (K - 300)", "0.1 * Y - 0.04 * K"), (100.0, 280.0), 1.0, 30)),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(ts: Column) -> Column:
    """A timestamp (without time zone) as days since 1970-01-01, as a double."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("double") / 86_400_000_000.0


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel (series_id, t in days, z) of the events table; only three columns are read."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series_id"), days(F.col("ts")).alias("t"), F.col("value").alias("z"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header. Without a schema all columns are read as text and made numbers where all values are."""
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    raw = spark.read.csv(path, header=True)
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.trim(F.col(f"`{c}`"))).alias(c) for c in raw.columns])
    bad = clean.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in clean.columns]).first()
    return clean.select(*[F.col(f"`{c}`").cast("double").alias(c) if bad[c] == 0 else F.col(f"`{c}`") for c in clean.columns])


def time_column(df: DataFrame) -> str | None:
    return next((c for c in TIME_NAMES if c in df.columns), None)


def with_numeric_time(df: DataFrame, name: str | None = None) -> DataFrame:
    """Add ``time``: the column as a number, dates as days since 1970-01-01.

    For text the first format that reads at least one value is used.
    """
    name = name or time_column(df)
    if name is None:
        raise ValueError("no time column")
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.NumericType):
        return df.withColumn("time", c.cast("double"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.withColumn("time", F.unix_date(c.cast("date")).cast("double"))
    parsed = {f: F.unix_date(F.try_to_timestamp(c, F.lit(f)).cast("date")).cast("double") for f in DATE_FORMATS}
    counts = df.agg(*[F.count(p).alias(str(i)) for i, p in enumerate(parsed.values())]).first()
    chosen = next((p for p, n in zip(parsed.values(), counts, strict=True) if n), F.lit(None).cast("double"))
    return df.withColumn("time", chosen)


def list_examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, v) for n, (v, _) in EXAMPLES.items()], "name string, variables string")


def load_example(spark: SparkSession, name: str) -> DataFrame:
    """An example series, made from its equations by Runge-Kutta steps of a tenth of its time step."""
    if name not in EXAMPLES:
        raise ValueError(f"unknown example {name!r}; there are: {', '.join(EXAMPLES)}")
    import numpy as np

    from ..functions.equations import Equation

    variables, (rates, start, step, steps) = EXAMPLES[name]
    names = [v.strip() for v in variables.split(",")]
    equations = [Equation(e) for e in rates]

    def f(x: np.ndarray) -> np.ndarray:
        return np.array([float(e.values(dict(zip(names, x, strict=True)))) for e in equations])

    x, rows, h = np.array(start), [], step / 10
    for i in range(steps + 1):
        rows.append((round(i * step, 10), *map(float, x)))
        for _ in range(10):
            k1 = f(x)
            k2 = f(x + h / 2 * k1)
            k3 = f(x + h / 2 * k2)
            x = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + f(x + h * k3))
    return spark.createDataFrame(rows, "time double, " + ", ".join(f"{n} double" for n in names))


def prepare(df: DataFrame, response: str, predictors: list[str], outliers: float | None = None, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows where response and predictors are finite, without outliers of the response; and counts of what went.

    An outlier is more than ``outliers`` standard deviations from the mean; that is looked at
    with more than 10 valid rows and some spread. Fewer than ``least`` rows left is an error
    when the counts are read.
    """
    missing = [c for c in (response, *predictors) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    ok = F.lit(True)
    for c in (response, *predictors):
        ok = ok & finite(F.col(c).cast("double")).isNotNull()
    y = F.col(response).cast("double")
    stats = df.filter(ok).agg(F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    d = df.crossJoin(F.broadcast(stats))  # one row
    far = F.lit(False) if outliers is None else (F.col("_n") > 10) & (F.col("_sd") > 1e-10) & (F.abs(y - F.col("_mean")) > outliers * F.col("_sd"))
    counts = d.agg(F.count(F.lit(1)).alias("n_original"), F.count_if(~ok).alias("n_invalid_removed"), F.count_if(ok & far).alias("n_outliers_removed"), F.count_if(ok & ~far).alias("n_final"))
    counts = counts.filter(F.when(F.col("n_final") < least, F.raise_error(F.lit("too few rows left")).isNull()).otherwise(True))
    return d.filter(ok & ~far).drop("_mean", "_sd", "_n"), counts
