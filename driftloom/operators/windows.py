"""Window operators: rolling statistics, autocorrelation, change points, runs, interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..shipping import shipped
from .banded import order_balance
from .panel import Panel, row_numbers

#: Rows to each side up to which a peak's variance is run over its rows in order; wider ones are added up.
MOST_RUN = 50_000


def middle(values: Column) -> Column:
    """Median of an array."""
    s, n = F.array_sort(values), F.size(values)
    upper, lower = F.element_at(s, (F.floor(n / 2) + 1).cast("int")), F.element_at(s, F.greatest(F.lit(1), F.floor((n + 1) / 2)).cast("int"))
    return F.when(n > 0, (upper + lower) / 2)


def rolling_median(df: DataFrame, panel: Panel = Panel(), half: int = 10, out: str = "median") -> DataFrame:
    """Median of the ``half`` rows before to ``half`` rows after, fewer at the ends."""
    return df.withColumn(out, middle(F.collect_list(F.col(panel.value)).over(panel.frame(-half, half))))


def autocorrelations(df: DataFrame, panel: Panel = Panel(), lags: int = 10) -> DataFrame:
    """Rows (keys, lag, acf): sum of products of centred values ``lag`` apart over the sum of squares."""
    x = F.col("_x")
    d = df.withColumn("_x", F.col(panel.value) - F.avg(panel.value).over(panel.whole))
    d = d.withColumns({f"_l{k}": x * F.lag(x, k).over(panel.order) for k in range(1, lags + 1)})
    sums = d.groupBy(*panel.keys).agg(F.sum(x * x).alias("_s"), F.count(F.lit(1)).alias("_n"), *[F.sum(f"_l{k}").alias(f"_l{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_l{k}") / F.nullif(F.col("_s"), F.lit(0.0))).alias("acf")) for k in range(1, lags + 1)])
    return sums.select(*panel.keys, "_n", F.inline(pairs)).filter("lag < _n").drop("_n")


def change_points(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Rows at local peaks of the rolling variance that exceed its mean by two standard deviations.

    The window is a tenth of the series to each side, at least 5 rows. Series of up to 20
    rows, and series with more than five such rows, have none.
    """
    x, half = F.col(panel.value).cast("double"), F.greatest(F.lit(5), F.floor(F.col("n") / 10)).cast("int")
    d = row_numbers(df, panel).withColumn("_x", x - F.avg(x).over(panel.whole))
    # A row counts from ``half`` places before its own to ``half`` after: it enters and leaves running sums.
    known, zero = F.col("_x").isNotNull(), F.lit(0.0)
    part = lambda at, sign, row: F.struct(at.alias("_at"), (sign * F.coalesce("_x", zero)).alias("_s"), (sign * F.coalesce(F.col("_x") * F.col("_x"), zero)).alias("_q"), (sign * known.cast("int")).alias("_m"), row.alias("_row"))
    row = F.struct(panel.time, "rn", "n")
    none = F.lit(None).cast(d.select(row.alias("r")).schema["r"].dataType)
    events = F.array(part(F.col("rn") - half, F.lit(1), none), part(F.col("rn") + half + 1, F.lit(-1), none), part(F.col("rn"), F.lit(0), row))
    so_far = W.partitionBy(*panel.keys).orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    d = d.select(*panel.keys, F.inline(events)).withColumns({c: F.sum(c).over(so_far) for c in ("_s", "_q", "_m")}).filter("_row is not null")
    m = F.col("_m")
    variance = F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / F.nullif(m, F.lit(0))) / F.nullif(m - 1, F.lit(0)), zero)
    d = d.select(*panel.keys, "_row.*", F.when(m > 1, variance).alias("variance"))
    v = F.col("variance")
    limit = F.avg(v).over(panel.whole) + 2 * F.stddev_samp(v).over(panel.whole)
    peak = (v > limit) & (v > F.lag(v).over(panel.order)) & (v > F.lead(v).over(panel.order)) & (F.col("n") > 20)
    d = d.withColumn("_peak", peak)
    found = d.withColumn("_k", F.count_if("_peak").over(panel.whole)).filter("_peak and _k <= 5").select(*panel.keys, panel.time, "rn", half.alias("_half"))
    # Running sums cancel; what is returned is computed again from each peak's own rows, at most n a series. The variance
    # of values with few decimals often ends on a 5: which way it rounds is left to the order, from the last row to the first.
    rows = row_numbers(df, panel).select(*panel.keys, F.col("rn").alias("_other"), F.col(panel.value).alias("_v"))
    near = found.join(rows, list(panel.keys)).filter(F.abs(F.col("_other") - F.col("rn")) <= F.col("_half"))
    own = [*panel.keys, panel.time, "rn"]
    wide = F.col("_half") > MOST_RUN
    e = F.col("_v") - F.avg("_v").over(W.partitionBy(*own))
    near = near.withColumn("_d", F.when(wide, e * e)).withColumn("_kept", F.when(~wide, F.struct("_other", "_v")))
    of_peak = near.groupBy(*panel.keys, panel.time, F.col("rn").cast("long").alias("rn"))
    sums = of_peak.agg(F.sum("_d").alias("_d"), F.count("_v").alias("_m"), F.sort_array(F.collect_list("_kept"), asc=False).alias("_kept"))
    variance = F.when(F.size("_kept") > 0, running_variance(F.col("_kept._v"))).otherwise(F.col("_d") / F.nullif(F.col("_m") - 1, F.lit(0)))
    return sums.select(*panel.keys, panel.time, "rn", variance.alias("variance"))


def running_variance(values: Column) -> Column:
    """Sample variance of an array by running means, in the array's order: the last digit depends on the order. Nulls are left out."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("s"))

    def add(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["s"] + (x - mean) * (x - a["mean"])).alias("s"))

    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), start, add, lambda a: F.when(a["n"] > 1, a["s"] / (a["n"] - 1)))


def kendall(df: DataFrame, panel: Panel = Panel()) -> DataFrame:
    """Rows (keys, tau): sum of the signs of all later-minus-earlier differences over the number of pairs.

    Merge counting on each series; null and NaN values are in no pair but count for the number of
    pairs. Null for a single row.
    """
    keys = list(panel.keys)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(panel.time, kind="stable")[panel.value].to_numpy(float)
        pairs = len(v) * (len(v) - 1) / 2
        return rows[keys].head(1).assign(tau=order_balance(v[~np.isnan(v)]) / pairs if pairs else None)

    d = df.select(*keys, panel.time, panel.value)
    return shipped(d).groupBy(*keys).applyInPandas(one, StructType([*d.select(*keys).schema.fields, StructField("tau", DoubleType())]))


def interpolate(left: DataFrame, right: DataFrame, panel: Panel = Panel(), value: str = "x", clamp: bool = True) -> DataFrame:
    """``left`` with ``value`` of ``right`` at its times: linear between neighbours in time.

    Outside of the known times the nearest value holds (``clamp``) or there is none. Both
    sides go through one window per series; no pair of times is compared.
    """
    keys, t = list(panel.keys), panel.time
    known = right.select(*keys, F.col(t).alias(t), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumn("_row", F.struct(*left.columns)).select(*keys, t, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side"), "_row")
    line = known.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows)
    before = W.partitionBy(*keys).orderBy(t, "_side").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(t, F.desc("_side")).rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("_v").isNotNull(), F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    line = line.withColumn("_p", F.last(at, ignorenulls=True).over(before)).withColumn("_q", F.first(at, ignorenulls=True).over(after)).filter("_side = 1")
    p, q, now = F.col("_p"), F.col("_q"), F.col(t)
    between = F.when(q["t"] == p["t"], p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * (now - p["t"]) / F.nullif(q["t"] - p["t"], F.lit(0.0)))
    edge = F.coalesce(p["v"], q["v"]) if clamp else F.lit(None).cast("double")
    return line.select("_row.*", F.when(p.isNotNull() & q.isNotNull(), between).otherwise(edge).alias(value))


def rising_minimum(df: DataFrame, order: list[str], value: str, keys: list[str] | None = None) -> DataFrame:
    """Rows whose value is below all before them in ``order``: a Pareto front, one per key if there are ``keys``."""
    before = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_best", F.min(value).over(before)).filter(F.col("_best").isNull() | (F.col(value) < F.col("_best"))).drop("_best")
