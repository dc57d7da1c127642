"""What a panel's columns mean, and the windows that follow from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIME_NAMES = ("time", "t", "date", "year", "period", "Time", "Date", "Year")


@dataclass(frozen=True)
class Panel:
    """Column roles: series keys, time, the value, and predictors."""

    keys: tuple[str, ...] = ("series_id",)
    time: str = "t"
    value: str = "z"
    endogenous: tuple[str, ...] = ()
    exogenous: tuple[str, ...] = ()
    slow: tuple[str, ...] = ()

    @property
    def order(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(self.time)

    @property
    def whole(self) -> WindowSpec:
        return W.partitionBy(*self.keys)

    def frame(self, before: int, after: int) -> WindowSpec:
        return self.order.rowsBetween(before, after)

    @property
    def modelled(self) -> tuple[str, ...]:
        return self.endogenous or (self.value,)

    @property
    def predictors(self) -> tuple[str, ...]:
        return (*self.modelled, *self.exogenous, *self.slow)


def specify_variables(df: DataFrame, **roles) -> Panel:
    """A Panel whose columns are known to exist; the time column is found by name if not given."""
    if "time" not in roles:
        roles["time"] = next((c for c in TIME_NAMES if c in df.columns), "t")
    panel = Panel(**roles)
    asked = {*panel.keys, panel.time, *panel.endogenous, *panel.exogenous, *panel.slow} | ({panel.value} if not panel.endogenous else set())
    missing = sorted(asked - set(df.columns))
    if missing:
        raise ValueError(f"Variables not found: {', '.join(missing)}")
    return panel


def derivative_column(df: DataFrame) -> str:
    """The only column named like a derivative (d_x, or d and a capital)."""
    import re

    found = [c for c in df.columns if re.match(r"d_|d[A-Z]", c)]
    if len(found) != 1:
        raise ValueError(f"expected one derivative column, found {found}")
    return found[0]


def row_numbers(df: DataFrame, panel: Panel) -> DataFrame:
    """Add rn (1..n by time) and n for each series."""
    return df.withColumn("rn", F.row_number().over(panel.order)).withColumn("n", F.count(F.lit(1)).over(panel.whole))


def validate_series(df: DataFrame, panel: Panel, least: int = 10) -> DataFrame:
    """Per series: n, n_missing (null or NaN), and whether it can be analysed."""
    x = F.col(panel.value)
    return df.groupBy(*panel.keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull() | F.isnan(x)).alias("n_missing")).withColumn("valid", (F.col("n") >= least) & (F.col("n_missing") == 0))


def centred(x: Column, over: WindowSpec) -> Column:
    return x - F.avg(x).over(over)
