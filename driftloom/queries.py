"""Registered queries over the panel tables, each with its SQL twin where one can be written.

Results are rounded alike on both sides, as sums in another order differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.equations import Equation, structure
from .operators import bounded, certify, derivatives, dynamics, figures, glm, moments, refit, regression, sampling, search, smooth, systems, validation, windows
from .operators.lineage import settled
from .operators.panel import Panel, row_numbers
from .plans import explore, models, stochastic
from .sources import tables, writers

PANEL = Panel()
Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
SQL: dict[str, str] = {}

P = "p AS (SELECT user_id AS series_id, epoch_us(ts)::DOUBLE / 86400000000::DOUBLE AS t, value AS z FROM events)"
Q = P + ", q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM p)"
W = "(PARTITION BY series_id ORDER BY t)"
FD = "(coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z)) / nullif(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t), 0)"
D = Q + f", d AS (SELECT *, {FD} AS d_z FROM q WINDOW w AS (PARTITION BY series_id ORDER BY t))"


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTERED[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def panel(spark: SparkSession, d: str) -> DataFrame:
    return tables.events_panel(spark, d)


def with_derivative(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.finite_difference(panel(spark, d), PANEL)


@query("dv02_finite_difference", f"WITH {D} SELECT series_id, round(t, 6) + 0.0 AS t, z, round(d_z, 4) + 0.0 AS d_z FROM d")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return rounded(with_derivative(spark, d), "t").withColumn("d_z", r("d_z", 4))


def savgol_rows() -> list[list[float]]:
    """What each of eleven values counts in the derivative, at each of eleven places, of their least-squares cubic."""
    at = np.arange(11.0) - 5
    powers = np.linalg.pinv(np.vander(at, 4, increasing=True))
    return [(powers[1] + 2 * u * powers[2] + 3 * u * u * powers[3]).tolist() for u in at]


SG = "CASE place " + " ".join(f"WHEN {i} THEN {[float(f'{x:.17g}') for x in w]}" for i, w in enumerate(savgol_rows())) + " END"


@query("dv03_savgol", f"""WITH {Q}, s AS (SELECT series_id, n, (max(t) - min(t)) / (n - 1) AS step, list(z ORDER BY t) AS zs FROM q GROUP BY series_id, n),
f AS (SELECT q.series_id, rn, q.n, step, zs, least(greatest(rn - 6, 0), q.n - 11) AS first FROM q JOIN s USING (series_id)), g AS (SELECT *, (rn - 1 - first)::INTEGER AS place FROM f)
SELECT series_id, rn::INTEGER AS rn, round(list_inner_product({SG}, zs[first + 1 : first + 11]) / step, 5) + 0.0 AS d_z FROM g""")
def savgol(spark: SparkSession, d: str) -> DataFrame:
    s = row_numbers(derivatives.savitzky_golay(panel(spark, d), PANEL, 3, 11), PANEL)
    return s.select("series_id", "rn", r("d_z", 5).alias("d_z"))


@query("wn02_reconstruction", f"WITH {D}, e AS (SELECT *, d_z * (lead(t) OVER w - t) AS part, first_value(z) OVER w AS z1 FROM d WINDOW w AS {W}) SELECT series_id, rn::INTEGER AS rn, round(z1 + coalesce(sum(part) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) + 0.0 AS z_hat FROM e")
def reconstruction(spark: SparkSession, d: str) -> DataFrame:
    s = derivatives.reconstruct(with_derivative(spark, d), PANEL)
    return row_numbers(s, PANEL).select("series_id", "rn", r("z_hat", 4).alias("z_hat"))


@query("wn03_rolling_median", f"WITH {Q} SELECT series_id, rn::INTEGER AS rn, round(median(z) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) + 0.0 AS median FROM q")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return row_numbers(windows.rolling_median(panel(spark, d), PANEL), PANEL).select("series_id", "rn", r("median").alias("median"))


ACF = f"{Q}, c AS (SELECT *, z - avg(z) OVER (PARTITION BY series_id) AS x FROM q), l AS (SELECT c.series_id, k.lag, n, x, lag(x, k.lag) OVER (PARTITION BY c.series_id, k.lag ORDER BY t) AS y FROM c, (SELECT unnest(range(1, 11))::INTEGER AS lag) k), acf AS (SELECT series_id, lag, max(n) AS n, sum(x * y) / nullif(sum(x * x), 0) AS acf FROM l GROUP BY ALL HAVING lag < max(n))"


@query("wn04_autocorrelation", f"WITH {ACF} SELECT series_id, lag, round(acf, 6) + 0.0 AS acf FROM acf")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.autocorrelations(panel(spark, d), PANEL, 10), "acf")


@query("wn06_change_points", f"""WITH {Q}, h AS (SELECT *, greatest(5, n // 10) AS half FROM q),
v AS (SELECT a.series_id, a.t, a.rn, max(a.n) AS n, var_samp(b.z) AS variance FROM h a JOIN h b ON a.series_id = b.series_id AND abs(a.rn - b.rn) <= a.half GROUP BY a.series_id, a.t, a.rn),
k AS (SELECT *, variance > avg(variance) OVER s + 2 * stddev_samp(variance) OVER s AND variance > lag(variance) OVER w AND variance > lead(variance) OVER w AND n > 20 AS peak FROM v WINDOW s AS (PARTITION BY series_id), w AS {W}),
m AS (SELECT *, count(*) FILTER (peak) OVER (PARTITION BY series_id) AS c FROM k)
SELECT series_id, round(t, 6) + 0.0 AS t, rn::BIGINT AS rn, round(variance, 4) + 0.0 AS variance FROM m WHERE peak AND c <= 5""")
def change_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.change_points(panel(spark, d), PANEL), "t").withColumn("variance", r("variance", 4))


@query("jn04_kendall", f"WITH {Q} SELECT a.series_id, round(sum(sign(a.z - b.z)) / (max(a.n) * (max(a.n) - 1) / 2.0), 8) + 0.0 AS tau FROM q a JOIN q b ON a.series_id = b.series_id AND a.rn > b.rn GROUP BY a.series_id")
def kendall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.kendall(panel(spark, d), PANEL), "tau", digits=8)


@query("jn06_interpolation_clamped", f"""WITH {Q}, e AS (SELECT * FROM q WHERE rn % 2 = 1), o AS (SELECT * FROM q WHERE rn % 2 = 0)
SELECT o.series_id, o.rn::INTEGER AS rn, round(CASE WHEN b.t IS NULL THEN a.z ELSE a.z + (b.z - a.z) * (o.t - a.t) / (b.t - a.t) END, 5) + 0.0 AS x
FROM o JOIN e a ON a.series_id = o.series_id AND a.rn = o.rn - 1 LEFT JOIN e b ON b.series_id = o.series_id AND b.rn = o.rn + 1""")
def interpolation(spark: SparkSession, d: str) -> DataFrame:
    rows = row_numbers(panel(spark, d), PANEL)
    known = rows.filter("rn % 2 = 1").select("series_id", "t", F.col("z").alias("x"))
    return windows.interpolate(rows.filter("rn % 2 = 0"), known, PANEL, "x").select("series_id", "rn", r("x", 5).alias("x"))


M3 = "avg(z*z*z) - 3*avg(z*z)*avg(z) + 2*avg(z)*avg(z)*avg(z)"


@query("ag03_describe", f"""WITH {P}, c AS (SELECT series_id, z, avg(z) OVER (PARTITION BY series_id) AS m FROM p)
SELECT series_id, count(*) AS n, round(avg(z), 6) + 0.0 AS mean, round(stddev_samp(z), 6) + 0.0 AS sd, min(z) AS min, max(z) AS max,
round(avg((z - m) ** 3) / stddev_samp(z) ** 3, 6) + 0.0 AS skewness, round(avg((z - m) ** 4) / stddev_samp(z) ** 4 - 3, 6) + 0.0 AS kurtosis FROM c GROUP BY series_id""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.describe(panel(spark, d), PANEL), "mean", "sd", "skewness", "kurtosis")


@query("ag04_ljung_box", f"WITH {ACF} SELECT series_id, least(10, max(n) // 5)::INTEGER AS df, round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 5) + 0.0 AS statistic FROM acf WHERE lag <= least(10, n // 5) AND n >= 10 GROUP BY series_id")
def ljung_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.ljung_box(panel(spark, d), PANEL), "statistic", digits=5)


def projected(source: str, columns: list[str], target: str, over: str) -> tuple[str, str]:
    """SQL that regresses ``target`` on ``columns`` of the table ``source`` inside ``over``: CTEs that make each column orthogonal to those before, and R^2."""
    out, done = [], []
    centred = ", ".join(f"{c} - avg({c}) OVER {over} AS {c}" for c in [*columns, target])
    out.append(f"o0 AS (SELECT * REPLACE ({centred}) FROM {source})")
    for i, c in enumerate(columns):
        less = "".join(f" - {d} * coalesce(sum({c} * {d}) OVER {over} / nullif(sum({d} * {d}) OVER {over}, 0), 0)" for d in done)
        out.append(f"o{i + 1} AS (SELECT * REPLACE ({c}{less} AS {c}) FROM o{i})")
        done.append(c)
    explained = " + ".join(f"coalesce(sum({target} * {c}) ** 2 / nullif(sum({c} * {c}), 0), 0)" for c in columns)
    return ", ".join(out), f"({explained}) / sum({target} * {target})"


ARCH_LAGS = ", ".join(f"CASE WHEN df >= {i} THEN lag(z * z, {i}) OVER w ELSE 0 END AS x{i}" for i in range(1, 6))
ARCH, ARCH_R2 = projected("e", [f"x{i}" for i in range(1, 6)], "y", "(PARTITION BY series_id)")


@query("ag05_arch", f"WITH {Q}, l AS (SELECT *, least(5, floor(n / 10))::INTEGER AS df FROM q), e0 AS (SELECT series_id, rn, n, df, z * z AS y, {ARCH_LAGS} FROM l WINDOW w AS {W}), e AS (SELECT * FROM e0 WHERE n >= 20 AND rn > df), {ARCH} SELECT series_id, df, round(n * {ARCH_R2}, 4) + 0.0 AS statistic FROM o5 GROUP BY series_id, df, n")
def arch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.arch(panel(spark, d), PANEL), "statistic", digits=4)


@query("ag06_breusch_pagan", f"""WITH {Q}, f AS (SELECT series_id, regr_slope(z, t) AS b, regr_intercept(z, t) AS a FROM q GROUP BY series_id), e AS (SELECT q.series_id, t, (z - a - b * t) ** 2 AS e2 FROM q JOIN f USING (series_id))
SELECT series_id, round(count(*) * regr_r2(e2, t), 4) + 0.0 AS statistic FROM e GROUP BY series_id""")
def breusch_pagan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.breusch_pagan(panel(spark, d), PANEL, "z", "t").drop("df"), "statistic", digits=4)


@query("ag07_jarque_bera", f"""WITH {P}, c AS (SELECT series_id, z - avg(z) OVER (PARTITION BY series_id) AS x FROM p),
m AS (SELECT series_id, count(*) AS n, avg(x ** 3) / avg(x * x) ** 1.5 AS s, avg(x ** 4) / avg(x * x) ** 2 - 3 AS k FROM c GROUP BY series_id)
SELECT series_id, round(n / 6.0 * (s * s + k * k / 4), 5) + 0.0 AS statistic, round(exp(-n / 12.0 * (s * s + k * k / 4)), 6) + 0.0 AS p_value FROM m WHERE n >= 10""")
def jarque_bera(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.jarque_bera(panel(spark, d), PANEL), "p_value").withColumn("statistic", r("statistic", 5))


@query("ag08_runs_test", f"""WITH {Q}, m AS (SELECT *, z > median(z) OVER (PARTITION BY series_id) AS up FROM q), s AS (SELECT *, coalesce((up <> lag(up) OVER {W})::INT, 1) AS new FROM m),
g AS (SELECT series_id, sum(new)::DOUBLE AS r, sum(up::INT)::DOUBLE AS n1, count(*)::DOUBLE - sum(up::INT)::DOUBLE AS n2, count(*)::DOUBLE AS n FROM s GROUP BY series_id)
SELECT series_id, r::BIGINT AS runs, round((r - (2 * n1 * n2 / n + 1)) / sqrt(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))), 6) + 0.0 AS statistic FROM g""")
def runs_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.runs(panel(spark, d), PANEL), "statistic")


@query("ag09_residual_diagnostics")
def residual_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return moments.diagnostics(panel(spark, d), PANEL)


@query("ag10_normal_fit", f"""WITH {P}, s AS (SELECT series_id, count(*) AS n, avg(z) AS m, stddev_samp(z) AS sd FROM p GROUP BY series_id)
SELECT series_id, round(sum(-0.5 * ln(2 * pi()) - ln(sd) - (z - m) ** 2 / (2 * sd * sd)), 4) + 0.0 AS loglik, round(max(m), 6) + 0.0 AS mean, round(max(sd), 6) + 0.0 AS sd, round(4 - 2 * sum(-0.5 * ln(2 * pi()) - ln(sd) - (z - m) ** 2 / (2 * sd * sd)), 4) + 0.0 AS aic FROM p JOIN s USING (series_id) GROUP BY series_id""")
def normal_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.normal_fit(panel(spark, d), PANEL), "mean", "sd").withColumns({c: r(c, 4) for c in ("loglik", "aic")})


NU = ", ".join(f"({v})" for v in (2, 3, 4, 5, 7, 10, 15, 20, 30, 50))


@query("ag11_t_fit", f"""WITH {P}, s AS (SELECT series_id, avg(z) AS m, stddev_samp(z) AS sd FROM p GROUP BY series_id), nu(v) AS (VALUES {NU}),
l AS (SELECT series_id, v, sum(lgamma((v + 1) / 2.0) - lgamma(v / 2.0) - 0.5 * ln(v * pi()) - (v + 1) / 2.0 * ln(1 + ((z - m) / sd) ** 2 / v) - ln(sd)) AS loglik FROM p JOIN s USING (series_id), nu GROUP BY series_id, v)
SELECT series_id, arg_max(v, loglik)::INTEGER AS nu, round(max(loglik), 4) + 0.0 AS loglik FROM l GROUP BY series_id""")
def t_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.t_fit(panel(spark, d), PANEL), "loglik", digits=4)


@query("ag12_weighted_deviance", f"WITH {Q}, f AS (SELECT *, median(z) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS fit FROM q) SELECT series_id, round(sum(rn * (z - fit) ** 2) / sum(rn), 4) + 0.0 AS deviance FROM f GROUP BY series_id")
def weighted_deviance(spark: SparkSession, d: str) -> DataFrame:
    f = row_numbers(windows.rolling_median(panel(spark, d), PANEL), PANEL).withColumn("rn", F.col("rn").cast("double"))
    return rounded(moments.weighted_deviance(f, ["series_id"], "z", "median", "rn"), "deviance", digits=4)


@query("ag13_iterate_change", f"WITH {Q}, f AS (SELECT *, median(z) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS fit FROM q) SELECT series_id, round(sqrt(sum((fit - z) ** 2) / count(*)) / (sqrt(sum(z * z) / count(*)) + 1e-12), 6) + 0.0 AS change FROM f GROUP BY series_id")
def iterate_change(spark: SparkSession, d: str) -> DataFrame:
    f = windows.rolling_median(panel(spark, d), PANEL).withColumn("one", F.lit(1.0))
    return rounded(moments.iterate_change(f, ["series_id"], "median", "z", "one"), "change")


@query("ag17_fit_statistics", f"""WITH {Q}, c AS (SELECT series_id, regr_slope(z, rn) AS b, regr_intercept(z, rn) AS a FROM q GROUP BY series_id), e AS (SELECT series_id, z, z - a - b * rn AS e FROM q JOIN c USING (series_id)),
s AS (SELECT series_id, count(*) AS n, sum(e * e) AS rss, 1 - sum(e * e) / (count(*) * var_pop(z)) AS r2, avg(abs(e)) AS mae FROM e GROUP BY series_id)
SELECT series_id, n, round(r2, 6) + 0.0 AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) + 0.0 AS adj_r_squared, round(sqrt(rss / n), 6) + 0.0 AS rmse, round(mae, 6) + 0.0 AS mae, round(n * (ln(rss / n) + ln(2 * pi()) + 1) + 6, 4) + 0.0 AS aic, round(n * (ln(rss / n) + ln(2 * pi()) + 1) + 3 * ln(n), 4) + 0.0 AS bic FROM s""")
def fit_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = row_numbers(panel(spark, d), PANEL)
    fit = regression.least_squares(rows, ["series_id"], F.col("z"), {"rn": F.col("rn")}).select("series_id", F.col("`(Intercept)`").alias("a"), F.col("rn").alias("b"))
    fitted = rows.join(fit, "series_id").withColumn("fit", F.col("a") + F.col("b") * F.col("rn"))
    s = moments.fit_statistics(fitted, ["series_id"], "z", "fit", 2)
    return rounded(s, "r_squared", "adj_r_squared", "rmse", "mae").withColumns({c: r(c, 4) for c in ("aic", "bic")})


@query("ag19_coefficient_table", f"""WITH {Q}, s AS (SELECT series_id, count(*)::DOUBLE AS n, avg(rn) AS mx, regr_sxx(z, rn) AS sxx, regr_slope(z, rn) AS b, regr_intercept(z, rn) AS a, (regr_syy(z, rn) - regr_sxy(z, rn) ** 2 / regr_sxx(z, rn)) / (count(*) - 2) AS s2 FROM q GROUP BY series_id),
u AS (SELECT series_id, '(Intercept)' AS term, a AS estimate, sqrt(s2 * (1 / n + mx * mx / sxx)) AS std_error FROM s UNION ALL SELECT series_id, 'rn', b, sqrt(s2 / sxx) FROM s)
SELECT series_id, term, round(estimate, 5) + 0.0 AS estimate, round(std_error, 5) + 0.0 AS std_error, round(estimate - 1.96 * std_error, 5) + 0.0 AS lower, round(estimate + 1.96 * std_error, 5) + 0.0 AS upper FROM u""")
def coefficient_table(spark: SparkSession, d: str) -> DataFrame:
    fit = regression.least_squares(row_numbers(panel(spark, d), PANEL), ["series_id"], F.col("z"), {"rn": F.col("rn")})
    return rounded(regression.coefficient_table(fit, ["series_id"], ["(Intercept)", "rn"]), "estimate", "std_error", "lower", "upper", digits=5)


@query("ag22_target_summary", f"""WITH {Q}, s AS (SELECT series_id, avg(z) AS mean, stddev_samp(z) AS sd, min(z) AS min, max(z) AS max, corr(rn, z) AS trend FROM q GROUP BY series_id)
SELECT series_id, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, min, max, round(trend, 6) + 0.0 AS trend, CASE WHEN abs(trend) > 0.7 THEN 'strong trend' WHEN abs(trend) > 0.3 THEN 'moderate trend' ELSE 'no trend' END AS verdict FROM s""")
def target_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(moments.target_summary(panel(spark, d), PANEL), "mean", "sd", "trend")


@query("ft01_least_squares", f"WITH {Q} SELECT series_id, count(*) AS n, round(regr_intercept(z, rn), 5) + 0.0 AS intercept, round(regr_slope(z, rn), 6) + 0.0 AS slope, round(regr_syy(z, rn) - regr_sxy(z, rn) ** 2 / regr_sxx(z, rn), 3) + 0.0 AS rss FROM q GROUP BY series_id")
def least_squares(spark: SparkSession, d: str) -> DataFrame:
    fit = regression.least_squares(row_numbers(panel(spark, d), PANEL), ["series_id"], F.col("z"), {"rn": F.col("rn")})
    return fit.select("series_id", "n", r(F.col("`(Intercept)`"), 5).alias("intercept"), r("rn").alias("slope"), r("rss", 3).alias("rss"))


@query("ft01_weighted", f"""WITH {Q}, x AS (SELECT *, t + 1e6 AS x, z + 1e7 AS y, 1.0 + rn % 3 AS w FROM q), m AS (SELECT series_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM x GROUP BY series_id), s AS (SELECT series_id, count(*) AS n, sum(w * (x - mx) ** 2) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (y - my) ** 2) AS syy FROM x JOIN m USING (series_id) GROUP BY series_id)
SELECT series_id, n, round(sxy / sxx, 5) + 0.0 AS slope, round(syy - sxy ** 2 / sxx, 2) + 0.0 AS rss, round(syy, 2) + 0.0 AS tss FROM s""")
def weighted_least_squares(spark: SparkSession, d: str) -> DataFrame:
    rows = row_numbers(panel(spark, d), PANEL)
    fit = regression.least_squares(rows, ["series_id"], F.col("z") + 1e7, {"x": F.col("t") + 1e6}, 1.0 + F.col("rn") % 3)
    return fit.select("series_id", "n", r("x", 5).alias("slope"), r("rss", 2).alias("rss"), r("tss", 2).alias("tss"))


@query("ft11_variance_model", f"""WITH {Q}, c AS (SELECT series_id, avg(z) AS m FROM q GROUP BY series_id), e AS (SELECT q.series_id, rn, abs(z - m) AS y FROM q JOIN c USING (series_id))
SELECT series_id, round(regr_intercept(y, rn), 5) + 0.0 AS intercept, round(regr_slope(y, rn), 6) + 0.0 AS slope FROM e GROUP BY series_id""")
def variance_model(spark: SparkSession, d: str) -> DataFrame:
    e = row_numbers(panel(spark, d), PANEL).withColumn("e", F.col("z") - F.avg("z").over(PANEL.whole))
    m = regression.variance_model(e, ["series_id"], "e", ["rn"])
    return m.select("series_id", r(F.col("`(Intercept)`"), 5).alias("intercept"), r("rn").alias("slope"))


@query("ft12_quadratic_variation", f"""WITH {Q}, v AS (SELECT *, (lead(z) OVER {W} - z) ** 2 / nullif(lead(t) OVER {W} - t, 0) AS qv FROM q),
m AS (SELECT *, CASE WHEN qv IS NOT NULL THEN sqrt(median(qv) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) END AS g FROM v)
SELECT series_id, rn::INTEGER AS rn, round(coalesce(g, lag(g) OVER {W}), 5) + 0.0 AS diffusion FROM m""")
def quadratic_variation(spark: SparkSession, d: str) -> DataFrame:
    return row_numbers(regression.quadratic_variation(panel(spark, d), PANEL), PANEL).select("series_id", "rn", r("diffusion", 5).alias("diffusion"))


@query("ft12_diffusion_on_state", f"""WITH {Q}, v AS (SELECT *, (lead(z) OVER {W} - z) ** 2 / nullif(lead(t) OVER {W} - t, 0) AS qv FROM q),
m AS (SELECT *, CASE WHEN qv IS NOT NULL THEN sqrt(median(qv) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) END AS g FROM v),
f AS (SELECT *, coalesce(g, lag(g) OVER {W}) AS g2 FROM m)
SELECT series_id, count(g2) AS n, round(regr_intercept(g2, z), 4) + 0.0 AS level, round(regr_slope(g2, z), 6) + 0.0 AS slope FROM f GROUP BY series_id""")
def diffusion_on_state(spark: SparkSession, d: str) -> DataFrame:
    m = regression.diffusion_model(panel(spark, d), PANEL, ["z"])
    return m.select("series_id", "n", r("(Intercept)", 4).alias("level"), r("z").alias("slope"))


@query("ft11_smooth_variance")
def smooth_variance(spark: SparkSession, d: str) -> DataFrame:
    """Residuals' size around every series' line in time, as a smooth of time and one of the value before: its freedom, fit and predicted range."""
    w = PANEL.order
    rows = panel(spark, d).withColumn("before", F.lag("z").over(w))
    line = regression.least_squares(rows, ["series_id"], F.col("z"), {"t": F.col("t")}).select("series_id", F.col("(Intercept)").alias("a"), F.col("t").alias("b"))
    e = rows.join(line, "series_id").withColumn("e", F.col("z") - F.col("a") - F.col("b") * F.col("t")).filter("before IS NOT NULL")
    fits = regression.variance_model(e, ["series_id"], "e", ["t", "before"], method="gam")
    sizes = smooth.predict_additive(e, fits, ["series_id"], ["t", "before"]).withColumn("sd", regression.to_sd(F.col("prediction"), "absolute"))
    spread = sizes.groupBy("series_id").agg(F.min("sd").alias("least_sd"), F.max("sd").alias("most_sd"))
    return rounded(fits.select("series_id", "n", "edf", "gcv", "rss", "tss").join(spread, "series_id"), "edf", "gcv", "rss", "tss", "least_sd", "most_sd", digits=3)


@query("dv12_sampling", f"""WITH {Q}, g AS (SELECT *, z - lag(z) OVER {W} AS dz, t - lag(t) OVER {W} AS dt, rn - (n + 1) / 2.0 AS place FROM q),
s AS (SELECT series_id, n, avg(dt) AS mean_dt, stddev_samp(dt) / avg(dt) AS dt_cv, avg(dz) AS mdz, avg(z) AS mz, sum(z * place) / sum(place * place) AS slope, n // 10 AS m FROM g GROUP BY series_id, n),
l AS (SELECT series_id, dz - mdz AS e, lag(dz - mdz) OVER u AS e1, lag(dz - mdz, 5) OVER u AS e5 FROM g JOIN s USING (series_id) WHERE rn > 1 WINDOW u AS (PARTITION BY series_id ORDER BY rn)),
a AS (SELECT series_id, sum(e * e1) / sum(e * e) AS a1, sum(e * e5) / sum(e * e) AS a5 FROM l GROUP BY series_id),
sizes AS (SELECT (2 ** a * 3 ** b * 5 ** c)::BIGINT AS size FROM range(20) x(a), range(13) y(b), range(9) w(c) WHERE 2 ** a * 3 ** b * 5 ** c <= 1000000),
fast AS (SELECT n, min(size) AS size FROM (SELECT DISTINCT n FROM q) JOIN sizes ON size >= n GROUP BY n),
x AS (SELECT g.series_id, g.rn, size, (z - mz - slope * place) * CASE WHEN rn <= m THEN 0.5 * (1 - cos(pi() * (2 * rn - 1) / (2 * m))) WHEN rn > g.n - m THEN 0.5 * (1 - cos(pi() * (2 * (g.n - rn) + 1) / (2 * m))) ELSE 1 END AS x FROM g JOIN s USING (series_id) JOIN fast ON fast.n = g.n),
pw AS (SELECT series_id, size, f, sum(x * cos(2 * pi() * f * (rn - 1) / size)) ** 2 + sum(x * sin(2 * pi() * f * (rn - 1) / size)) ** 2 AS power FROM (SELECT *, unnest(range(1, size // 2 + 1)) AS f FROM x) GROUP BY ALL),
k AS (SELECT series_id, arg_max(f::DOUBLE / size, power) AS peak FROM pw GROUP BY series_id),
o AS (SELECT *, 1 / (peak * mean_dt) AS samples, least(20, n // 4, n - 2) >= 5 AND abs(a5) > 0.8 * abs(a1) AND a1 > 0.5 AS over FROM s JOIN a USING (series_id) JOIN k USING (series_id))
SELECT series_id, n, round(mean_dt, 6) + 0.0 AS mean_dt, round(dt_cv, 4) + 0.0 AS dt_cv, dt_cv ** 2 < 0.01 AS uniform_sampling, round(a1, 6) + 0.0 AS first_acf, over AS oversampled, round(peak, 6) + 0.0 AS dominant_frequency, round(samples, 4) + 0.0 AS samples_per_cycle, samples < 4 AS aliasing_risk,
CASE WHEN over THEN 'Consider subsampling data' WHEN samples < 4 THEN 'Sample more frequently to avoid aliasing' ELSE 'Sampling frequency appears adequate' END AS recommendation FROM o WHERE n >= 4""")
def sampling_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    s = sampling.diagnose_sampling(panel(spark, d), PANEL).filter("n >= 4")
    return s.select("series_id", "n", r("mean_dt").alias("mean_dt"), r("dt_cv", 4).alias("dt_cv"), "uniform_sampling", r(F.col("acf")[0]).alias("first_acf"), "oversampled", r("dominant_frequency").alias("dominant_frequency"), r("samples_per_cycle", 4).alias("samples_per_cycle"), "aliasing_risk", "recommendation")


@query("ft05_start_values", f"""WITH {P}, g(v) AS (VALUES (-10.0::DOUBLE), (-1.0), (-0.1), (0.1), (1.0), (10.0)), e AS (SELECT a.v AS a, b.v AS b, avg((z - (a.v + b.v * sin(t))) ** 2) AS mse FROM p, g a, g b GROUP BY ALL)
SELECT a, b FROM e ORDER BY mse, a, b LIMIT 1""")
def start_values(spark: SparkSession, d: str) -> DataFrame:
    got = regression.start_values(panel(spark, d), Equation("a + b * sin(t)"), "z")
    return spark.createDataFrame([(got["a"], got["b"])], "a double, b double")


@query("ft03_bounded", f"""WITH {Q}, w AS (SELECT *, 1.0 + rn % 3 AS w FROM q), m AS (SELECT series_id, sum(w * rn) / sum(w) AS mx, sum(w * z) / sum(w) AS mz FROM w GROUP BY series_id),
s AS (SELECT series_id, mx, mz, count(*) AS n, sum(w * (rn - mx) ** 2) AS sxx, sum(w * (rn - mx) * (z - mz)) AS sxz, sum(w * (z - mz) ** 2) AS szz FROM w JOIN m USING (series_id) GROUP BY ALL), b AS (SELECT *, greatest(-0.02, least(0.02, sxz / sxx)) AS b FROM s)
SELECT series_id, n, round(mz - b * mx, 2) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(szz - 2 * b * sxz + b * b * sxx, 2) + 0.0 AS rss, CASE WHEN abs(b) >= 0.02 THEN 'b' ELSE '' END AS at_bound FROM b""")
def bounded_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = row_numbers(panel(spark, d), PANEL).withColumn("w", 1.0 + F.col("rn") % 3)
    fit = bounded.fit_bounded(rows.drop("n"), ["series_id"], Equation("a + b * rn"), "z", {"a": 0.0, "b": 1.0}, {"b": -0.02}, {"b": 0.02}, "w")
    return fit.select("series_id", "n", r("a", 2).alias("a"), r("b", 5).alias("b"), r("rss", 2).alias("rss"), F.array_join("at_bound", ",").alias("at_bound"))


@query("ft03_cascade")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    """A start at which the loss is not finite: the grid takes over."""
    rows = row_numbers(panel(spark, d), PANEL).drop("n")
    fit = bounded.fit_bounded(rows, ["series_id"], Equation("a * exp(b * rn / 100)"), "z", {"a": 1.0, "b": 1e5})
    return fit.select("series_id", "n", "a", "b", "rss", "converged", "method")


GLM_CASES = {"poisson": ("l_linenumber", "ln({})", "2 * sum(CASE WHEN y = 0 THEN 0 ELSE y * ln(y / m) END - (y - m))"), "binomial": ("CAST(l_discount > 0.05 AS INT)", "ln({0} / (1 - {0}))", "2 * sum(CASE WHEN y = 1 THEN -ln(m) ELSE -ln(1 - m) END)"), "gamma": ("l_extendedprice", "1 / ({})", "-2 * sum(ln(y / m) - (y - m) / m)")}
GLM_SQL = " UNION ALL ".join(f"SELECT '{name}' AS family, l_returnflag, count(*) AS n, round({link.format('avg(y) FILTER (x = 0)')}, 8) + 0.0 AS intercept, round({link.format('avg(y) FILTER (x = 1)')} - ({link.format('avg(y) FILTER (x = 0)')}), 8) + 0.0 AS slope, round({dev}, 3) + 0.0 AS deviance FROM (SELECT l_returnflag, x, y, avg(y) OVER (PARTITION BY l_returnflag, x) AS m FROM (SELECT l_returnflag, CAST(l_quantity > 25 AS INT) AS x, ({target})::DOUBLE AS y FROM lineitem)) GROUP BY l_returnflag" for name, (target, link, dev) in GLM_CASES.items())


@query("ft02_glm", GLM_SQL)
def generalised(spark: SparkSession, d: str) -> DataFrame:
    """Models with one indicator, whose solutions are known from group means."""
    rows, out = tables.read(spark, d, "lineitem"), None
    x = {"x": (F.col("l_quantity") > 25).cast("double")}
    for family, (target, *_) in GLM_CASES.items():
        fit = glm.glm(rows.withColumn("y", F.expr(target)), ["l_returnflag"], "y", x, family)
        part = fit.select(F.lit(family).alias("family"), "l_returnflag", "n", r("`(Intercept)`", 8).alias("intercept"), r("x", 8).alias("slope"), r("deviance", 3).alias("deviance"))
        out = part if out is None else out.unionByName(part)
    return out


@query("pr10_glm_folds")
def glm_folds(spark: SparkSession, d: str) -> DataFrame:
    """Poisson cross-validation on the scale of the response."""
    rows = tables.read(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("y"), (F.col("l_quantity") / 50).cast("double").alias("x"), (F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(5)) + 1).cast("int").alias("fold"))
    return glm.cross_validate_glm(rows, ["l_returnflag"], "y", {"x": F.col("x")}, "poisson")


CASES = ["2.5 * x^2 + 3", "-1.5 * x", "x + 1e-14", "sin(2 * x) - 0.5", "inv(x + 3) * -2"]


@query("ft06_parameterise", "SELECT * FROM (VALUES ('2.5 * x^2 + 3', 'c1 * x ^ 2 + c2', 2), ('-1.5 * x', 'c1 * x', 1), ('x + 1e-14', 'x + c1', 1), ('sin(2 * x) - 0.5', 'sin(c1 * x) - c2', 2), ('inv(x + 3) * -2', 'inv(x + c1) * c2', 2)) AS v(equation, parameterised, n)")
def parameterise(spark: SparkSession, d: str) -> DataFrame:
    rows = [(c, e.text, len(e.coefficients)) for c in CASES for e in [Equation(c).parameterised(["x"])]]
    return spark.createDataFrame(rows, "equation string, parameterised string, n int")


@query("pr02_transformations", f"WITH {P} SELECT series_id, round(t, 6) + 0.0 AS t, round(ln(abs(z) + 1e-10), 6) + 0.0 AS log_z, round(sqrt(abs(z)), 6) + 0.0 AS sqrt_z, round(z * z, 4) + 0.0 AS sq_z FROM p")
def transformations(spark: SparkSession, d: str) -> DataFrame:
    out = explore.transformations(panel(spark, d), ["z", "absent"])
    return out.select("series_id", r("t").alias("t"), r("log_z").alias("log_z"), r("sqrt_z").alias("sqrt_z"), r("sq_z", 4).alias("sq_z"))


@query("pr05_predict", f"WITH {P} SELECT series_id, round(t, 6) + 0.0 AS t, round(0.5 * z - 0.01 * z * z + exp(-z) + CASE WHEN z > 5 THEN 1 ELSE 0 END, 6) + 0.0 AS prediction FROM p")
def predict(spark: SparkSession, d: str) -> DataFrame:
    e = Equation("a * z - b * z^2 + exp(-z) + threshold(z, 5)", {"a": 0.5, "b": 0.01})
    return regression.predict(panel(spark, d), e).select("series_id", r("t").alias("t"), r("prediction").alias("prediction"))


@query("pr09_residuals", f"WITH {D} SELECT series_id, rn::INTEGER AS rn, round(d_z - (1 - 0.5 * z), 4) + 0.0 AS residual FROM d")
def residuals(spark: SparkSession, d: str) -> DataFrame:
    e = regression.residuals(with_derivative(spark, d), Equation("1 - 0.5 * z"))
    return row_numbers(e, PANEL).select("series_id", "rn", r("residual", 4).alias("residual"))


@query("pr12_validate_series", f"WITH {P} SELECT series_id, count(*) AS n, count(*) FILTER (z IS NULL OR isnan(z)) AS n_missing, count(*) >= 10 AND count(*) FILTER (z IS NULL OR isnan(z)) = 0 AS valid FROM p GROUP BY series_id")
def validate_series(spark: SparkSession, d: str) -> DataFrame:
    from .operators.panel import validate_series as check

    return check(panel(spark, d), PANEL)


@query("pr16_structure", "SELECT DISTINCT regexp_replace(round(o_totalprice, 1)::VARCHAR || ' * x + ' || o_orderstatus, '-?\\d+\\.?\\d*([eE][+-]?\\d+)?', 'C', 'g') AS structure FROM orders")
def structures(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.round("o_totalprice", 1).cast("string"), F.lit(" * x + "), F.col("o_orderstatus"))
    return tables.read(spark, d, "orders").select(structure(text).alias("structure")).distinct()


@query("pr17_detect_constants", "WITH c(label, known) AS (VALUES " + ", ".join(f"('{n}{s}', {v!r}::DOUBLE)" for n, c in search.CONSTANTS.items() for s, v in (("", c), ("*2", 2 * c), ("/2", c / 2), ("^2", c * c), ("^-1", 1 / c), ("*4", 4 * c))) + ") SELECT DISTINCT value, label FROM events JOIN c ON abs(abs(value) - known) <= 0.01 * greatest(abs(value), known)")
def detect_constants(spark: SparkSession, d: str) -> DataFrame:
    return search.detect_constants(tables.read(spark, d, "events").select("value"))


FRONT = "c AS (SELECT l_linenumber AS complexity, round(avg(l_extendedprice) / 1e4, 4) + l_suppkey % 7 AS mse, 'f' || (l_suppkey % 7)::VARCHAR AS equation FROM lineitem GROUP BY l_linenumber, l_suppkey % 7), f AS (SELECT *, min(mse) OVER (ORDER BY complexity, mse, equation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c), g AS (SELECT complexity, mse, equation FROM f WHERE best IS NULL OR mse < best)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("l_suppkey") % 7).cast("int")
    rows = tables.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("complexity"), k.alias("k")).agg(F.avg("l_extendedprice").alias("a"))
    return rows.select("complexity", (F.round(F.col("a") / 1e4, 4) + F.col("k")).alias("mse"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("equation"))


@query("ss09_pareto_front", f"WITH {FRONT} SELECT complexity, round(mse, 4) + 0.0 AS mse, round(sqrt(mse), 6) + 0.0 AS rmse, equation FROM g")
def pareto(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.pareto_front(candidates(spark, d)), "rmse").withColumn("mse", r("mse", 4))


@query("ss10_best_by_complexity", f"WITH {FRONT} SELECT complexity, round(mse, 4) + 0.0 AS mse, equation FROM (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY mse, equation) AS k FROM c) WHERE k = 1")
def best_by_complexity(spark: SparkSession, d: str) -> DataFrame:
    return search.best_by_complexity(candidates(spark, d)).select("complexity", r("mse", 4).alias("mse"), "equation")


@query("ss12_select_bic", f"WITH {FRONT} SELECT complexity, round(mse, 4) + 0.0 AS mse, equation FROM g ORDER BY 100 * ln(mse) + complexity * ln(100), complexity LIMIT 1")
def select_bic(spark: SparkSession, d: str) -> DataFrame:
    return search.select_equation(search.pareto_front(candidates(spark, d)), "BIC").select("complexity", r("mse", 4).alias("mse"), "equation")


@query("jn09_match_back", f"WITH {FRONT} SELECT complexity, round(mse, 4) + 0.0 AS mse, (SELECT min(c.equation) FROM c WHERE c.complexity = g.complexity AND abs(c.mse - g.mse) < 1e-10) AS record FROM g")
def match_back(spark: SparkSession, d: str) -> DataFrame:
    all_of_them = candidates(spark, d)
    return search.match_back(search.pareto_front(all_of_them), all_of_them).select("complexity", r("mse", 4).alias("mse"), F.col("record.equation").alias("record"))


@query("pz08_front_table", f"""WITH {FRONT}, b AS (SELECT complexity FROM g ORDER BY 100 * ln(mse) + complexity * ln(100), complexity LIMIT 1)
SELECT c.complexity, round(sqrt(c.mse), 6) + 0.0 AS rmse, c.equation, g.equation IS NOT NULL AS on_front, g.equation IS NOT NULL AND c.complexity IN (FROM b) AS is_selected FROM c LEFT JOIN g ON g.complexity = c.complexity AND g.equation = c.equation""")
def front_table(spark: SparkSession, d: str) -> DataFrame:
    found = candidates(spark, d)
    return rounded(figures.front_table(search.pareto_front(found), found, "BIC"), "rmse")


def scored(text: str) -> str:
    return f"SELECT '{text}' AS equation, avg((d_z - ({text})) ** 2) AS mse, avg(abs(d_z - ({text}))) AS mae, var_pop(d_z) AS v FROM d WHERE d_z IS NOT NULL"


@query("ss15_front_scores", f"WITH {D}, s AS ({scored('0.5')} UNION ALL {scored('50 - z')} UNION ALL {scored('40 - 0.8 * z')} UNION ALL {scored('20 * sin(z)')}) SELECT equation, regexp_replace(equation, '\\d+\\.?\\d*', 'C', 'g') AS structure, round(mse, 4) + 0.0 AS mse, round(mae, 6) + 0.0 AS mae, round(greatest(-1, least(1, 1 - mse / v)), 8) + 0.0 AS r_squared FROM s")
def front_scores(spark: SparkSession, d: str) -> DataFrame:
    s = search.front_scores(with_derivative(spark, d), "d_z", [Equation(e) for e in ("0.5", "50 - z", "40 - 0.8 * z", "20 * sin(z)")])
    return s.select("equation", "structure", r("mse", 4).alias("mse"), r("mae").alias("mae"), r("r_squared", 8).alias("r_squared"))


@query("pz09_histogram", f"""WITH {P}, s AS (SELECT series_id, count(*) AS n, min(z) AS lo, max(z) AS hi FROM p GROUP BY series_id), c AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / ceil(log2(n) + 1) END AS cell FROM s),
b AS (SELECT *, 10.0::DOUBLE ** floor(log10(cell)) AS base FROM c), w AS (SELECT *, coalesce(CASE WHEN cell IS NULL THEN 1.0 WHEN NOT 2 * base - cell < 1.5 * (cell - base) THEN base WHEN NOT 5 * base - cell < 2.75 * (cell - 2 * base) THEN 2 * base WHEN NOT 10 * base - cell < 1.5 * (cell - 5 * base) THEN 5 * base ELSE 10 * base END, 1.0)::DOUBLE AS width FROM b),
e AS (SELECT *, floor(lo / width + 1e-7)::BIGINT + 1 AS a FROM w), f AS (SELECT *, greatest(ceil(hi / width - 1e-7)::BIGINT, a) AS o FROM e), g AS (SELECT *, unnest(range(a, o + 1)) AS k FROM f),
h AS (SELECT p.series_id, least(greatest(ceil(z / width - 1e-7)::BIGINT, a), o) AS k, count(*) AS c FROM p JOIN f USING (series_id) GROUP BY ALL)
SELECT series_id, (k - a + 1)::INTEGER AS bin, round((k - 1) * width, 6) + 0.0 AS low, round(k * width, 6) + 0.0 AS high, coalesce(c, 0) AS count, round(coalesce(c, 0) / (n * width), 8) + 0.0 AS density FROM g LEFT JOIN h USING (series_id, k)""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(figures.histogram(panel(spark, d), ["series_id"], "z"), "low", "high").withColumn("density", r("density", 8))


@query("pz09_normal_pairs", f"""WITH {P}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY z, t) AS rank, count(*) OVER (PARTITION BY series_id) AS n FROM p)
SELECT series_id, round(t, 6) + 0.0 AS t, rank, n, round((rank - a) / (n + 1 - 2 * a), 8) + 0.0 AS p, z AS sample FROM (SELECT *, CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END::DOUBLE AS a FROM k)""")
def normal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(figures.normal_pairs(panel(spark, d), ["series_id"], "z", "t"), "t").withColumn("p", r("p", 8)).drop("theoretical")


@query("fp08_certified_draws", f"""WITH {D}, c AS (SELECT regr_intercept(d_z, z) AS a, regr_slope(d_z, z) AS b FROM d GROUP BY series_id), m AS (SELECT avg(a) AS a, avg(b) AS b FROM c WHERE a IS NOT NULL), g AS (SELECT unnest(range(0, 101))::DOUBLE AS x)
SELECT count(*) AS n, 0.0::DOUBLE AS error, round(greatest(1, max(abs(a + b * x))), 4) + 0.0 AS scale FROM g, m""")
def certified_draws(spark: SparkSession, d: str) -> DataFrame:
    """A line for every series as draws of one: their average over a grid of 101 points, held against the line of averages."""
    fits = regression.least_squares(with_derivative(spark, d), ["series_id"], F.col("d_z"), {"z": F.col("z")})
    draws = fits.select(F.col("series_id").alias("draw"), F.col("(Intercept)").alias("a"), F.col("z").alias("b")).dropna()
    points = dynamics.line(spark, 0.0, 100.0, 101)
    mean = draws.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first().asDict()
    certify.verify_substitution(points, lambda c: Equation("a + b * z", c).column(), mean, {"b": mean["b"] + 1.0}, {"b": F.col("z")})
    row = certify.certify_draws(points, draws, {"a": F.lit(1.0), "b": F.col("z")}, Equation("a + b * z", mean).column())
    return rounded(spark.createDataFrame([(row.n, row.error, row.scale)], "n long, error double, scale double"), "error", "scale", digits=4)


@query("ss11_knee", f"""WITH {FRONT}, n AS (SELECT *, (complexity - min(complexity) OVER ()) / (max(complexity) OVER () - min(complexity) OVER () + 1e-10) AS u, (mse - min(mse) OVER ()) / (max(mse) OVER () - min(mse) OVER () + 1e-10) AS v FROM g),
e AS (SELECT *, first_value(u) OVER w AS u1, last_value(u) OVER w AS u2, first_value(v) OVER w AS v1, last_value(v) OVER w AS v2 FROM n WINDOW w AS (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT complexity, round(mse, 4) + 0.0 AS mse, equation FROM e ORDER BY round(coalesce(abs((v2 - v1) * u - (u2 - u1) * v + u2 * v1 - v2 * u1) / nullif(sqrt((u2 - u1) ** 2 + (v2 - v1) ** 2), 0), 0), 12) DESC, complexity LIMIT 1""")
def knee(spark: SparkSession, d: str) -> DataFrame:
    return search.knee(search.pareto_front(candidates(spark, d))).select("complexity", r("mse", 4).alias("mse"), "equation")


@query("ag14_ensemble", f"""WITH {FRONT}, s AS (SELECT regexp_replace(equation, '-?\\d+\\.?\\d*([eE][+-]?\\d+)?', 'C', 'g') AS structure, * FROM c)
SELECT structure, min(complexity) AS complexity, round(avg(mse), 6) + 0.0 AS mean_loss, round(stddev_samp(mse), 6) + 0.0 AS std_loss, min(equation) AS equation, count(*) AS n, round(count(*) / (1 + coalesce(stddev_samp(mse), 0)), 6) + 0.0 AS consistency FROM s GROUP BY structure""")
def ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.ensemble(candidates(spark, d)), "mean_loss", "std_loss", "consistency")


def one_regressor(form: str, complexity: int, x: str) -> str:
    return f"SELECT {complexity} AS complexity, '{form}' AS form, (regr_syy(y, {x}) - regr_sxy(y, {x}) ** 2 / regr_sxx(y, {x})) / count(*) AS mse FROM x"


SINGLES = " UNION ALL ".join(one_regressor(form.format(p), c, x.format(p)) for p in "ab" for form, c, x in (("{}", 1, "{}"), ("inv({})", 2, "(1 / {})"), ("square({})", 2, "({0} * {0})"), ("log(abs({}) + 1e-10)", 2, "ln({} + 1e-10)")))
PAIRS, PAIR_R2 = projected("x", ["a", "b"], "y", "()")
TRIPLES, TRIPLE_R2 = projected("x3", ["a", "b", "ab"], "y", "()")


@query("ss04_exhaustive", f"""WITH x AS (SELECT l_extendedprice / 1e4 AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE * 100 + 1 AS b FROM lineitem), x3 AS (SELECT *, a * b AS ab FROM x),
v AS ({SINGLES} UNION ALL SELECT * FROM (WITH {PAIRS} SELECT 3, 'a + b', (1 - {PAIR_R2}) * sum(y * y) / count(*) FROM o2) UNION ALL SELECT * FROM (WITH {TRIPLES} SELECT 3, 'a + b + a * b', (1 - {TRIPLE_R2}) * sum(y * y) / count(*) FROM o3))
SELECT complexity, form, round(mse, 6) + 0.0 AS mse FROM v""")
def exhaustive(spark: SparkSession, d: str) -> DataFrame:
    x = tables.read(spark, d, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("y"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_discount") * 100 + 1).cast("double").alias("b"))
    return search.exhaustive(x, "y", ["a", "b"]).select("complexity", "form", r("mse").alias("mse"))


@query("ss02_genetic")
def genetic(spark: SparkSession, d: str) -> DataFrame:
    found = search.genetic(with_derivative(spark, d).filter("d_z is not null"), "d_z", ["z"])
    return search.pareto_front(found)


@query("cv02_block_folds", f"WITH {Q} SELECT series_id, rn::INTEGER AS rn, greatest(1, ceil((rn - 1) * 5 / (n - 1)::DOUBLE))::INTEGER AS fold FROM q")
def block_folds(spark: SparkSession, d: str) -> DataFrame:
    return validation.block_folds(panel(spark, d), PANEL, 5).select("series_id", "rn", "fold")


@query("cv03_rolling_folds", f"WITH {Q} SELECT series_id, rn::INTEGER AS rn, fold, CASE WHEN rn >= n - (5 - fold + 1) * 3 + 1 THEN 'test' ELSE 'train' END AS role FROM q, (SELECT unnest(range(1, 6))::INTEGER AS fold) WHERE rn < n - (5 - fold + 1) * 3 + 4")
def rolling_folds(spark: SparkSession, d: str) -> DataFrame:
    return validation.rolling_folds(panel(spark, d), PANEL, 5, 3).select("series_id", "rn", "fold", "role")


@query("cv05_cross_validate", f"""WITH {Q}, b AS (SELECT *, greatest(1, ceil((rn - 1) * 5 / (n - 1)::DOUBLE))::INTEGER AS fold FROM q),
f AS (SELECT a.series_id, k.fold, regr_slope(z, rn) AS s, regr_intercept(z, rn) AS i, avg(z) AS m FROM b a JOIN (SELECT DISTINCT series_id, fold FROM b) k ON a.series_id = k.series_id AND a.fold <> k.fold GROUP BY ALL)
SELECT series_id, fold, count(*) AS n_test, round(sqrt(avg((z - i - s * rn) ** 2)), 4) + 0.0 AS rmse, round(avg(abs(z - i - s * rn)), 4) + 0.0 AS mae, round(1 - sum((z - i - s * rn) ** 2) / sum((z - m) ** 2), 4) + 0.0 AS r_squared FROM b JOIN f USING (series_id, fold) GROUP BY series_id, fold""")
def cross_validate(spark: SparkSession, d: str) -> DataFrame:
    b = validation.block_folds(panel(spark, d), PANEL, 5)
    s = refit.cross_validate_folds(b, ["series_id"], Equation("a + b * rn", {"a": 0.0, "b": 0.0}), "z")
    return s.select("series_id", "fold", "n_test", r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"), r("r_squared", 4).alias("r_squared"))


@query("vl02_sensitivity", f"""WITH {P} SELECT * FROM (SELECT 'a' AS parameter, 0.5::DOUBLE AS value, round(avg(abs(z)), 6) + 0.0 AS sensitivity FROM p UNION ALL SELECT 'b', 0.01, round(avg(z * z), 4) + 0.0 FROM p)""")
def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    s = validation.sensitivity(panel(spark, d), Equation("a * z - b * z^2", {"a": 0.5, "b": 0.01}))
    return s.select("parameter", "value", r("sensitivity", 6).alias("sensitivity")).withColumn("sensitivity", F.when(F.col("parameter") == "b", r("sensitivity", 4)).otherwise(F.col("sensitivity")))


@query("vl03_bootstrap")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).withColumn("x", F.col("t") - 19723.0)
    b = validation.bootstrap(rows, PANEL, F.col("z"), {"x": F.col("x")}, 20)
    q = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))
    return b.groupBy("series_id").agg(F.avg("x").alias("slope"), F.stddev_samp("x").alias("se"), q.alias("q"), F.count("x").alias("n")).select("series_id", "slope", "se", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "n")


@query("sm01_simulate", "WITH RECURSIVE s(step, value) AS (SELECT 0, 0.1::DOUBLE UNION ALL SELECT step + 1, value + 0.05 * (2 * value - value * value) FROM s WHERE step < 100) SELECT step, round(step * 0.05, 6) + 0.0 AS t, round(value, 8) + 0.0 AS value FROM s")
def simulate(spark: SparkSession, d: str) -> DataFrame:
    s = dynamics.simulate(spark, Equation("2 * z - z^2"), "z", 0.1, 0.05, 100)
    return s.select("step", r("t").alias("t"), r("value", 8).alias("value"))


@query("sm01_stochastic_fan")
def stochastic_fan(spark: SparkSession, d: str) -> DataFrame:
    return dynamics.fan(dynamics.simulate(spark, Equation("2 * z - z^2"), "z", 0.5, 0.02, 50, Equation("0.1 * z"), 100, "milstein"))


@query("ag16_trajectory_summary", "WITH e AS (SELECT date_trunc('month', o_orderdate) AS m, o_totalprice AS v FROM orders) SELECT m::DATE::VARCHAR AS month, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) + 0.0 AS sd, round(quantile_cont(v, 0.05), 4) + 0.0 AS q05, round(quantile_cont(v, 0.5), 4) + 0.0 AS q50, round(quantile_cont(v, 0.95), 4) + 0.0 AS q95 FROM e GROUP BY m")
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.col("o_totalprice").alias("value"))
    f = dynamics.fan(e.withColumn("step", F.lit(0)).withColumn("t", F.col("month")))
    return f.select(F.col("t").cast("string").alias("month"), *[r(c, 4).alias(c) for c in ("mean", "sd", "q05", "q50", "q95")])


@query("fp01_fixed_points", "SELECT * FROM (VALUES (0.0::DOUBLE, 'unstable', 2.0::DOUBLE), (2.0, 'stable', -2.0)) AS v(fixed_point, stability, eigenvalue)")
def fixed_points(spark: SparkSession, d: str) -> DataFrame:
    f = dynamics.analyse_fixed_points(spark, Equation("2 * z - z^2"), "z", -5, 5, 101)
    return rounded(f, "fixed_point", "eigenvalue")


@query("fp04_bifurcations", "WITH g AS (SELECT round(-1 + i * 0.1, 6) AS r FROM (SELECT unnest(range(0, 21)) AS i)), x AS (SELECT r, sqrt(r) AS z FROM g WHERE r > 0 UNION ALL SELECT r, -sqrt(r) FROM g WHERE r > 0 UNION ALL SELECT r, 0 FROM g WHERE r = 0) SELECT (r + 0.0)::DOUBLE AS r, round(z, 5) + 0.0 AS fixed_point, CASE WHEN z > 0 THEN 'stable' WHEN z < 0 THEN 'unstable' ELSE 'marginal' END AS stability FROM x")
def bifurcations(spark: SparkSession, d: str) -> DataFrame:
    found, _ = dynamics.analyse_bifurcations(spark, Equation("r - z^2", {"r": 0.0}), "z", "r", -1.0, 1.0, 21, -2.0, 2.0, 173)
    return found.select(r("r").alias("r"), r("fixed_point", 5).alias("fixed_point"), "stability")


@query("fp04_status", "SELECT round(-1 + i * 0.1, 6)::DOUBLE + 0.0 AS r, CASE WHEN i > 10 THEN 2 WHEN i = 10 THEN 1 ELSE 0 END::BIGINT AS n_fixed_points, CASE WHEN i >= 10 THEN 'ok' ELSE 'none' END AS status FROM (SELECT unnest(range(0, 21)) AS i)")
def bifurcation_status(spark: SparkSession, d: str) -> DataFrame:
    _, status = dynamics.analyse_bifurcations(spark, Equation("r - z^2", {"r": 0.0}), "z", "r", -1.0, 1.0, 21, -2.0, 2.0, 173)
    return status.select(r("r").alias("r"), "n_fixed_points", "status")


@query("fp03_consensus", f"""WITH {P}, h AS (SELECT series_id AS draw, min(z) AS lo, max(z) AS hi, avg(z) AS mid, count(*) AS n FROM p GROUP BY series_id),
x AS (SELECT draw, lo AS fixed_point, 'unstable' AS stability FROM h UNION ALL SELECT draw, hi, CASE WHEN hi - mid > 3 * (mid - lo) THEN 'stable' ELSE 'unstable' END FROM h UNION ALL SELECT draw, mid, 'stable' FROM h WHERE n % 3 > 0),
c AS (SELECT draw, count(*) AS m FROM x GROUP BY draw), mode AS (SELECT m, count(*) AS freq FROM c GROUP BY m ORDER BY freq DESC, m LIMIT 1),
k AS (SELECT x.*, freq, row_number() OVER (PARTITION BY x.draw ORDER BY fixed_point) AS branch FROM x JOIN c USING (draw) JOIN mode USING (m)),
s AS (SELECT branch, stability, count(*) AS n, row_number() OVER (PARTITION BY branch ORDER BY count(*) DESC, stability) AS r FROM k GROUP BY branch, stability)
SELECT k.branch::INTEGER AS branch, round(median(fixed_point), 6) + 0.0 AS fixed_point, round(quantile_cont(fixed_point, 0.05), 6) + 0.0 AS lower, round(quantile_cont(fixed_point, 0.95), 6) + 0.0 AS upper, any_value(s.stability) AS stability, round(any_value(s.n) / count(*), 6) + 0.0 AS prob_stability, round(any_value(freq) / (SELECT count(*) FROM h), 6) + 0.0 AS prob_n_fixed_points FROM k JOIN s ON s.branch = k.branch AND s.r = 1 GROUP BY k.branch""")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    h = panel(spark, d).groupBy(F.col("series_id").alias("draw")).agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg("z").alias("mid"), F.count("*").alias("n"))
    point = lambda c, s: F.struct(c.alias("fixed_point"), s.alias("stability"))
    upper = F.when(F.col("hi") - F.col("mid") > 3 * (F.col("mid") - F.col("lo")), "stable").otherwise("unstable")
    every = F.array(point(F.col("lo"), F.lit("unstable")), point(F.col("hi"), upper), F.when(F.col("n") % 3 > 0, point(F.col("mid"), F.lit("stable"))))
    points = h.select("draw", F.explode(every).alias("p")).filter("p is not null").select("draw", "p.*")
    return rounded(dynamics.consensus(points, h.count()), "fixed_point", "lower", "upper", "prob_stability", "prob_n_fixed_points")


LINE = f"{D}, b AS (SELECT series_id AS draw, regr_slope(d_z, z) AS b, regr_intercept(d_z, z) AS a FROM d GROUP BY series_id HAVING regr_sxx(d_z, z) > 0)"


def fitted_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rate of change of each series as a line in its value, as draws of (a, b)."""
    fit = regression.least_squares(with_derivative(spark, d), ["series_id"], F.col("d_z"), {"z": F.col("z")})
    return fit.select(F.col("series_id").alias("draw"), F.col("`(Intercept)`").alias("a"), F.col("z").alias("b")).filter("b is not null")


@query("fp01_fitted_fixed_points", f"WITH {LINE} SELECT draw, round(-a / b, 3) + 0.0 AS fixed_point, CASE WHEN b < -1e-6 THEN 'stable' WHEN b > 1e-6 THEN 'unstable' ELSE 'marginal' END AS stability FROM b WHERE abs(a / b) < 1000")
def fitted_fixed_points(spark: SparkSession, d: str) -> DataFrame:
    f = dynamics.analyse_fixed_points(spark, Equation("a + b * z"), "z", -1000.0, 1000.0, 201, draws=fitted_lines(spark, d), n_draws=None)
    return f.select("draw", r("fixed_point", 3).alias("fixed_point"), "stability")


@query("fp07_posterior_sweep", f"""WITH {LINE}, x AS (SELECT i::DOUBLE * 2 - 10 AS u, draw, -(a + i * 2 - 10) / b AS z, b FROM b, (SELECT unnest(range(0, 11)) AS i)), k AS (SELECT * FROM x WHERE abs(z) < 1000),
n AS (SELECT u, count(*) AS n, (SELECT count(*) FROM b) AS n_all, count(*) FILTER (b < -1e-6) AS stable, count(*) FILTER (b > 1e-6) AS unstable, median(z) AS fixed_point, quantile_cont(z, 0.05) AS lower, quantile_cont(z, 0.95) AS upper FROM k GROUP BY u)
SELECT u + 0.0 AS u, 1 AS branch, round(fixed_point, 3) + 0.0 AS fixed_point, round(lower, 3) + 0.0 AS lower, round(upper, 3) + 0.0 AS upper, CASE WHEN stable >= unstable THEN 'stable' ELSE 'unstable' END AS stability, round(greatest(stable, unstable) / n, 6) + 0.0 AS prob_stability, round(n / n_all, 6) + 0.0 AS prob_n_fixed_points FROM n WHERE n > n_all - n""")
def posterior_sweep(spark: SparkSession, d: str) -> DataFrame:
    draws = settled(fitted_lines(spark, d))
    found, _ = dynamics.analyse_bifurcations(spark, Equation("u + a + b * z"), "z", "u", -10.0, 10.0, 11, -1000.0, 1000.0, 201, draws=draws, n_draws=None)
    out = dynamics.consensus(found, draws.count(), keys=["u"]).withColumn("u", r("u"))
    return rounded(rounded(out, "prob_stability", "prob_n_fixed_points"), "fixed_point", "lower", "upper", digits=3)


@query("sm01_uneven_times", """WITH RECURSIVE e AS (SELECT date_diff('day', DATE '1992-01-01', date_trunc('month', o_orderdate)::DATE)::DOUBLE AS t, avg(o_totalprice) / 1e5 AS x FROM orders GROUP BY 1), k AS (SELECT i AS step, i * 7.0::DOUBLE + i % 3 AS t FROM (SELECT unnest(range(0, 61)) AS i)),
p AS (SELECT k.step, k.t, (SELECT max(t) FROM e WHERE e.t <= k.t) AS ta, (SELECT min(t) FROM e WHERE e.t >= k.t) AS tb FROM k), x AS (SELECT step, p.t, CASE WHEN ta IS NULL THEN b.x WHEN tb IS NULL OR ta = tb THEN a.x ELSE a.x + (b.x - a.x) * (p.t - ta) / (tb - ta) END AS x FROM p LEFT JOIN e a ON a.t = ta LEFT JOIN e b ON b.t = tb),
s(step, t, value) AS (SELECT step, t, 1.0::DOUBLE FROM x WHERE step = 0 UNION ALL SELECT n.step, n.t, s.value + (n.t - s.t) * (0.1 * x.x - 0.08 * s.value) FROM s JOIN x ON x.step = s.step JOIN x n ON n.step = s.step + 1)
SELECT step::INTEGER AS step, t, round(value, 6) + 0.0 AS value FROM s""")
def uneven_times(spark: SparkSession, d: str) -> DataFrame:
    month = F.datediff(F.trunc(F.col("o_orderdate").cast("date"), "month"), F.lit("1992-01-01")).cast("double")
    x = tables.read(spark, d, "orders").groupBy(month.alias("t")).agg((F.avg("o_totalprice") / 1e5).alias("x"))
    s = dynamics.simulate_at(spark, Equation("0.1 * x - 0.08 * z"), "z", 1.0, [i * 7.0 + i % 3 for i in range(61)], exogenous=x)
    return s.select("step", "t", r("value").alias("value"))


CURVE, _ = projected("u", ["u1", "u2", "u3"], "d_z", "(PARTITION BY series_id)")


def phase_sql(rows: str) -> str:
    """Twin of the three fits of d_z in z: powers of the standardised z made orthogonal, so that a far origin costs no digits."""
    return f"""WITH {D}, s AS (SELECT series_id, z{rows} AS z, d_z FROM d), u0 AS (SELECT *, (z - avg(z) OVER w) / coalesce(nullif(stddev_pop(z) OVER w, 0), 1) AS u1 FROM s WINDOW w AS (PARTITION BY series_id)), u AS (SELECT series_id, z, u1, u1 * u1 AS u2, u1 * u1 * u1 AS u3, d_z FROM u0), {CURVE},
e AS (SELECT series_id, count(*) AS n, min(z) AS low, max(z) AS high, sum(d_z * d_z) AS y0, sum(d_z * u1) ** 2 / sum(u1 * u1) AS y1, sum(d_z * u2) ** 2 / nullif(sum(u2 * u2), 0) AS y2, sum(d_z * u3) ** 2 / nullif(sum(u3 * u3), 0) AS y3 FROM o3 GROUP BY series_id),
a AS (SELECT series_id, n, low, high, n * ln(2 * pi() * (y0 - y1) / n) + n + 6 AS a1, n * ln(2 * pi() * (y0 - y1 - y2) / n) + n + 8 AS a2, n * ln(2 * pi() * (y0 - y1 - y2 - y3) / n) + n + 10 AS a3 FROM e),
l AS (SELECT series_id, corr(u1, d_z) AS correlation, regr_slope(d_z, u1) / stddev_pop(z) AS slope FROM u GROUP BY series_id)
SELECT series_id, n, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(correlation, 6) + 0.0 AS correlation, round(slope, 5) + 0.0 AS slope, round(a1, 3) + 0.0 AS aic_linear, round(a2, 3) + 0.0 AS aic_quadratic, round(a3, 3) + 0.0 AS aic_cubic, CASE WHEN a1 <= least(a2, a3) THEN 'linear' WHEN a2 <= a3 THEN 'quadratic' ELSE 'cubic' END AS form FROM a JOIN l USING (series_id)"""


def phase_of(rows: DataFrame) -> DataFrame:
    f = explore.phase(rows, ["series_id"], "d_z", "z")
    return f.select("series_id", "n", "form", *[r(c).alias(c) for c in ("low", "high", "correlation")], r("slope", 5).alias("slope"), *[r(f"aic_{k}", 3).alias(f"aic_{k}") for k in explore.FORMS])


@query("ex02_phase", phase_sql(""))
def phase(spark: SparkSession, d: str) -> DataFrame:
    return phase_of(with_derivative(spark, d))


@query("ex02_phase_far_origin", phase_sql(" + 19700"))
def phase_far_origin(spark: SparkSession, d: str) -> DataFrame:
    return phase_of(with_derivative(spark, d).withColumn("z", F.col("z") + 19700))


@query("ex03_tertiles", f"""WITH {Q}, b AS (SELECT series_id, quantile_cont(z, 1 / 3.0) AS a, quantile_cont(z, 2 / 3.0) AS c FROM q GROUP BY series_id), x AS (SELECT q.*, CASE WHEN z <= a THEN 1 WHEN z <= c THEN 2 ELSE 3 END AS bin FROM q JOIN b USING (series_id))
SELECT series_id, bin, count(*) AS n, round(CASE WHEN count(*) > 5 AND stddev_samp(z) > 0 THEN regr_slope(rn, z) END, 5) + 0.0 AS slope FROM x GROUP BY series_id, bin""")
def tertiles(spark: SparkSession, d: str) -> DataFrame:
    rows = row_numbers(panel(spark, d), PANEL)
    return rounded(explore.tertile_slopes(rows, ["series_id"], "rn", "z"), "slope", digits=5)


@query("ex04_interactions")
def interactions(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    return explore.interaction(rows, ["l_returnflag"], "y", "a", "b")


@query("dv11_suggest_method")
def suggest_method(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.suggest_method(panel(spark, d), PANEL)


@query("dv05_spectral")
def spectral(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.spectral(panel(spark, d), PANEL)


@query("dv04_spline")
def spline(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.smoothing_spline(panel(spark, d), PANEL)


@query("dv04_spline_freedom")
def spline_freedom(spark: SparkSession, d: str) -> DataFrame:
    """Every series' spline of eight degrees of freedom."""
    return derivatives.smoothing_spline(panel(spark, d), PANEL, freedom=8.0)


@query("dv06_total_variation")
def total_variation(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.total_variation(panel(spark, d), PANEL, penalty=1.0)


@query("io01_read_series", "SELECT o_orderdate::DATE::VARCHAR AS date, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS time, round(sum(o_totalprice), 2) + 0.0 AS value FROM orders GROUP BY o_orderdate::DATE")
def read_series(spark: SparkSession, d: str) -> DataFrame:
    days = tables.read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return tables.with_numeric_time(days, "date").select("date", "time", (F.col("value") + 0.0).alias("value"))


@query("io03_examples", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for n, (v, _) in tables.EXAMPLES.items()) + ") AS v(name, variables)")
def examples(spark: SparkSession, d: str) -> DataFrame:
    return tables.list_examples(spark)


@query("io04_prepare", "WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, avg(l_extendedprice) OVER () AS m, stddev_samp(l_extendedprice) OVER () AS s FROM lineitem) SELECT count(*) AS n_original, 0::BIGINT AS n_invalid_removed, count(*) FILTER (abs(y - m) > 2 * s) AS n_outliers_removed, count(*) FILTER (abs(y - m) <= 2 * s) AS n_final FROM v")
def prepare(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "lineitem")
    _, diagnostics = tables.prepare(rows, "l_extendedprice", ["l_quantity", "l_discount"], outliers=2.0)
    return diagnostics


@query("st01_set_operations", "SELECT n_name AS name FROM nation UNION ALL (SELECT r_name FROM region EXCEPT SELECT 'ASIA')")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    nations = tables.read(spark, d, "nation").select(F.col("n_name").alias("name"))
    regions = tables.read(spark, d, "region").select(F.col("r_name").alias("name"))
    return nations.unionByName(regions.filter("name <> 'ASIA'").distinct())


@query("ag18_model_comparison", f"""WITH {P}, m AS (SELECT 'flat' AS model, 1 AS k, z, 10.0::DOUBLE AS f FROM p UNION ALL SELECT 'line', 2, z, 9.0 + 0.01 * (t - 19723) FROM p), s AS (SELECT model, max(k) AS k, count(*) AS n, sum((z - f) ** 2) AS rss, 1 - sum((z - f) ** 2) / (count(*) * var_pop(z)) AS r2 FROM m GROUP BY model)
SELECT model, k::INTEGER AS k, round(r2, 6) + 0.0 AS r_squared, round(sqrt(rss / n), 6) + 0.0 AS rmse, round(n * (ln(rss / n) + ln(2 * pi()) + 1) + 2 * (k + 1), 2) + 0.0 AS aic FROM s""")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    got = models.compare(panel(spark, d), {"flat": Equation("a", {"a": 10.0}), "line": Equation("a + b * (t - 19723)", {"a": 9.0, "b": 0.01})}, "z")
    return got.select("model", "k", r("r_squared").alias("r_squared"), r("rmse").alias("rmse"), r("aic", 2).alias("aic"))


@query("fp05_qualitative", "SELECT * FROM (VALUES ('n_fixed_points', '2', '2', true), ('stability_pattern', 'unstable,stable', 'unstable,stable', true), ('bounded', 'true', 'false', false)) AS v(\"check\", expected, found, passed)")
def qualitative(spark: SparkSession, d: str) -> DataFrame:
    return models.qualitative_check(spark, Equation("2 * z - z^2"), "z", -5.0, 5.0, ["unstable", "stable"], 2, True)


@query("sd02_stochastic_model")
def stochastic_model(spark: SparkSession, d: str) -> DataFrame:
    m = models.stochastic_model(with_derivative(spark, d), PANEL, "d_z", ["z"])
    return m.drift.select("series_id", "iteration", F.col("`(Intercept)`").alias("intercept"), F.col("z").alias("slope")).join(m.diffusion.select("series_id", F.col("`(Intercept)`").alias("g0"), F.col("z").alias("g1")), "series_id")


def iterated_line(iterations: int, tolerance: float) -> str:
    """SQL of lines in z under weights from the residuals' size, iteration by iteration, each series up to where it stops."""

    def line(name: str, rows: str, y: str, w: str, least: int) -> str:
        return f"""{name}_m AS MATERIALIZED (SELECT series_id, sum({w} * z) / sum({w}) AS mz, sum({w} * {y}) / sum({w}) AS my FROM {rows} GROUP BY series_id),
{name}_s AS MATERIALIZED (SELECT series_id, count(*) AS n, any_value(mz) AS mz, any_value(my) AS my, sum({w} * (z - mz) * ({y} - my)) AS sxy, sum({w} * (z - mz) ** 2) AS sxx FROM {rows} JOIN {name}_m USING (series_id) GROUP BY series_id),
{name} AS MATERIALIZED (SELECT series_id, my - slope * mz AS a, slope AS b FROM (SELECT *, CASE WHEN n > {least} AND sqrt(sxx) > 1e-14 * abs(mz) THEN sxy / sxx ELSE 0 END AS slope FROM {name}_s))"""

    parts = ["x AS MATERIALIZED (SELECT series_id, z, d_z AS y FROM d WHERE d_z IS NOT NULL AND NOT isnan(d_z))", line("l0", "x", "y", "1.0::DOUBLE", 2)]
    for i in range(1, iterations + 1):
        parts += [
            f"r{i} AS MATERIALIZED (SELECT series_id, z, y, abs(y - (a + b * z)) AS e FROM x JOIN l{i - 1} USING (series_id))",
            line(f"g{i}", f"r{i}", "e", "1.0::DOUBLE", 0),
            f"w{i} AS MATERIALIZED (SELECT series_id, z, y, 1 / greatest(greatest(a + b * z, 0) ** 2, 1e-10) AS w FROM x JOIN g{i} USING (series_id))",
            line(f"l{i}", f"w{i}", "y", "w", 2),
            f"h{i} AS MATERIALIZED (SELECT series_id, {i} AS iteration, any_value(l.a) AS a, any_value(l.b) AS b, sum(w * (y - (l.a + l.b * z)) ** 2) / sum(w) AS deviance, sqrt(sum(w * (l.a + l.b * z - (o.a + o.b * z)) ** 2) / sum(w)) / (sqrt(sum(w * (o.a + o.b * z) ** 2) / sum(w)) + 1e-12) AS moved FROM w{i} JOIN l{i} l USING (series_id) JOIN l{i - 1} o USING (series_id) GROUP BY series_id)",
        ]
    every = " UNION ALL ".join(f"SELECT h{i}.*, g{i}.a AS g0, g{i}.b AS g1 FROM h{i} JOIN g{i} USING (series_id)" for i in range(1, iterations + 1))
    return f"""WITH {D}, {", ".join(parts)}, h AS ({every}),
c AS (SELECT *, abs(deviance - lag(deviance) OVER v) / (abs(lag(deviance) OVER v) + 1e-12) AS changed FROM h WINDOW v AS (PARTITION BY series_id ORDER BY iteration)),
e AS (SELECT series_id, min(iteration) FILTER (changed < {tolerance} AND moved < {tolerance}) AS stopped FROM c GROUP BY series_id)
SELECT series_id, coalesce(stopped, {iterations})::INTEGER AS n_iterations, stopped IS NOT NULL AS converged, CASE WHEN stopped IS NULL THEN 'max_iter' ELSE 'converged' END AS stop_reason, round(a, 3) + 0.0 AS intercept, round(b, 3) + 0.0 AS slope, round(g0, 3) + 0.0 AS g0, round(g1, 3) + 0.0 AS g1 FROM c JOIN e USING (series_id) WHERE iteration = coalesce(stopped, {iterations})"""


@query("sd02_iterative_line", iterated_line(4, 1e-3))
def iterative_line(spark: SparkSession, d: str) -> DataFrame:
    line = ({"z": F.col("z")}, [(1, ["z"])])
    m = stochastic.fit_stochastic(with_derivative(spark, d), PANEL, "d_z", ["z"], library=line, max_iterations=4, tolerance=1e-3, selection="deviance", diffusion="residual")
    both = m.drift.join(m.diffusion.select("series_id", "g"), "series_id")
    numbers = {"intercept": F.col("beta")[0], "slope": F.col("beta")[1], "g0": F.col("g")[0], "g1": F.col("g")[1]}
    return both.select("series_id", "n_iterations", "converged", "stop_reason", *[r(c, 3).alias(n) for n, c in numbers.items()])


@query("ss06_weighted_search")
def weighted_search(spark: SparkSession, d: str) -> DataFrame:
    """Every iteration of every series: the form found under its weights, its deviance, and its score under the last ones."""
    m = stochastic.fit_stochastic(with_derivative(spark, d), PANEL, "d_z", ["z"], criterion="BIC", max_iterations=5, tolerance=1e-3)
    chosen = m.drift.select("series_id", F.col("selected_iteration").alias("iteration"), F.lit(True).alias("selected"))
    return m.history.join(chosen, ["series_id", "iteration"], "left").fillna({"selected": False})


@query("pr08_predict_components")
def predict_components(spark: SparkSession, d: str) -> DataFrame:
    """Drift and diffusion of every row, from lines found for its series."""
    rows = with_derivative(spark, d)
    line = ({"z": F.col("z")}, [(1, ["z"])])
    m = stochastic.fit_stochastic(rows, PANEL, "d_z", ["z"], library=line, max_iterations=2)
    return m.predict(rows).select("series_id", "t", "z", "drift", "diffusion")


COUPLED = """pairs AS (SELECT a.series_id, a.rn, a.z AS x, b.z AS y FROM q a JOIN q b ON b.series_id = a.series_id + 1 AND b.rn = a.rn),
moves AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pairs WINDOW w AS (PARTITION BY series_id ORDER BY rn)),
s AS (SELECT series_id, avg(x) AS mx, avg(y) AS my, avg(dx) AS mdx, avg(dy) AS mdy, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, dx) AS xd, covar_pop(y, dx) AS yd, covar_pop(x, dy) AS xe, covar_pop(y, dy) AS ye FROM moves WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY series_id),
k AS (SELECT *, CASE WHEN xx > 0 AND yy > 0 AND 1 - abs(xy) / sqrt(xx * yy) >= 1e-12 THEN xx * yy - xy * xy END AS det FROM s),
f AS (SELECT series_id, mx, my, mdx, mdy, (xd * yy - yd * xy) / det AS ax, (yd * xx - xd * xy) / det AS ay, (xe * yy - ye * xy) / det AS bx, (ye * xx - xe * xy) / det AS by_ FROM k),
p0 AS (SELECT series_id, x, y, mdx - ax * mx - ay * my AS a0, ax, ay, mdy - bx * mx - by_ * my AS b0, bx, by_ FROM moves JOIN f USING (series_id) WHERE rn = 1),
path AS (SELECT series_id, 0 AS step, CASE WHEN a0 IS NOT NULL THEN x END AS x, CASE WHEN a0 IS NOT NULL THEN y END AS y, a0, ax, ay, b0, bx, by_ FROM p0
UNION ALL SELECT series_id, step + 1, x + a0 + ax * x + ay * y, y + b0 + bx * x + by_ * y, a0, ax, ay, b0, bx, by_ FROM path WHERE step < 20)"""


@query("sm01_coupled", f"WITH RECURSIVE {Q}, {COUPLED} SELECT series_id, step, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM path")
def coupled(spark: SparkSession, d: str) -> DataFrame:
    """Each series and the one after it: how both move with both is fitted, and simulated from where they began."""
    rows = row_numbers(panel(spark, d), PANEL).select("series_id", "rn", "z")
    pairs = rows.withColumnRenamed("z", "x").join(rows.select((F.col("series_id") - 1).alias("series_id"), "rn", F.col("z").alias("y")), ["series_id", "rn"])
    order = Panel(time="rn", value="x").order
    moves = pairs.withColumns({f"d{v}": F.lead(v).over(order) - F.col(v) for v in "xy"})
    starts = moves.filter("rn = 1").select("series_id", "x", "y")
    for v, names in (("x", ("a0", "ax", "ay")), ("y", ("b0", "bx", "by"))):
        fit = regression.least_squares(moves, ["series_id"], F.col(f"d{v}"), {"x": F.col("x"), "y": F.col("y")})
        starts = starts.join(fit.select("series_id", *[F.col(f"`{c}`").alias(n) for c, n in zip(("(Intercept)", "x", "y"), names, strict=True)]), "series_id")
    paths = systems.simulate_system(starts, ["series_id"], {"x": Equation("a0 + ax * x + ay * y"), "y": Equation("b0 + bx * x + by * y")}, 1.0, 20)
    return rounded(paths.select("series_id", "step", "x", "y"), "x", "y", digits=4)


@query("sm01_coupled_noise")
def coupled_noise(spark: SparkSession, d: str) -> DataFrame:
    """For every series a pair of paths with a noise in common: 200 simulations, their mean, spread and correlation at the end."""
    s = panel(spark, d).groupBy("series_id").agg(F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"), F.min_by("z", "t").alias("x"))
    starts = s.select("series_id", "x", F.col("mean").alias("y"), "mean", "sd")
    drift = {"x": Equation("0.5 * (mean - x)"), "y": Equation("0.5 * (x - y)")}
    noise = {"x": {"u": Equation("0.3 * sd")}, "y": {"u": Equation("0.1 * sd"), "v": Equation("0.1 * sd")}}
    end = systems.simulate_system(starts, ["series_id"], drift, 0.1, 50, noise, {("u", "v"): 0.5}, sims=200, first=50)
    return end.groupBy("series_id").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.stddev_samp("x").alias("sd_x"), F.stddev_samp("y").alias("sd_y"), F.corr("x", "y").alias("corr"))


@query("io06_to_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return writers.to_json(tables.read(spark, d, "region").select("r_regionkey", "r_name"))


BLOCKS = """b AS (SELECT *, rn::DOUBLE AS w, least(5, floor((rn * 5 - 1) / n) + 1) AS block FROM q),
s AS (SELECT series_id, block, sum(w) AS w0, sum(w * rn) AS w1, sum(w * rn * rn) AS w2, sum(w * z) AS v0, sum(w * rn * z) AS v1, count(*) AS c FROM b GROUP BY ALL),
o AS (SELECT series_id, block, w0 AS mass, c, sum(w0) OVER u - w0 AS a0, sum(w1) OVER u - w1 AS a1, sum(w2) OVER u - w2 AS a2, sum(v0) OVER u - v0 AS y0, sum(v1) OVER u - v1 AS y1 FROM s WINDOW u AS (PARTITION BY series_id)),
f AS (SELECT *, (a0 * y1 - a1 * y0) / (a0 * a2 - a1 * a1) AS slope FROM o),
e AS (SELECT series_id, block, any_value(mass) AS mass, sum(w * (z - (y0 - slope * a1) / a0 - slope * rn) ** 2) / any_value(mass) AS line, sum(w * (z - y0 / a0) ** 2) / any_value(mass) AS level FROM b JOIN f USING (series_id, block) WHERE c >= 2 GROUP BY ALL)"""


def weighted_rows(spark: SparkSession, d: str) -> DataFrame:
    return row_numbers(panel(spark, d), PANEL).withColumn("w", F.col("rn").cast("double")).withColumn("x", F.col("rn").cast("double")).drop("rn", "n")


@query("cv06_blocked_score", f"WITH {Q}, {BLOCKS} SELECT series_id, round(sum(line * mass) / sum(mass), 2) + 0.0 AS score FROM e GROUP BY series_id")
def blocked_score(spark: SparkSession, d: str) -> DataFrame:
    s = refit.blocked_score(weighted_rows(spark, d), PANEL, Equation("a + b * x", {"a": 0.0, "b": 0.0}), "z", "w")
    return rounded(s.select("series_id", "score"), "score", digits=2)


@query("cv07_select_iteration", f"WITH {Q}, {BLOCKS}, m AS (SELECT series_id, sum(line * mass) / sum(mass) AS line, sum(level * mass) / sum(mass) AS level FROM e GROUP BY series_id), c AS (SELECT 1 AS iteration, avg(level) AS score FROM m UNION ALL SELECT 2, avg(line) FROM m) SELECT iteration, round(score, 2) + 0.0 AS score FROM c ORDER BY c.score, iteration LIMIT 1")
def select_iteration(spark: SparkSession, d: str) -> DataFrame:
    rows, scores = weighted_rows(spark, d), None
    for i, e in enumerate((Equation("a", {"a": 0.0}), Equation("a + b * x", {"a": 0.0, "b": 0.0})), 1):
        s = refit.blocked_score(rows, PANEL, e, "z", "w").agg(F.lit(i).alias("iteration"), F.avg("score").alias("score"))
        scores = s if scores is None else scores.unionByName(s)
    return rounded(validation.select_iteration(scores), "score", digits=2)


@query("ag15_compare_trajectories", "SELECT metric, round(value, 6) + 0.0 AS value FROM (WITH RECURSIVE s(step, v) AS (SELECT 0, 0.1::DOUBLE UNION ALL SELECT step + 1, v + 0.05 * (2 * v - v * v) FROM s WHERE step < 100), o AS (SELECT v, v + 0.01 * (step % 3) AS y FROM s) SELECT 'RMSE (mean)' AS metric, sqrt(avg((y - v) ** 2)) AS value FROM o UNION ALL SELECT 'RMSE (median)', sqrt(avg((y - v) ** 2)) FROM o UNION ALL SELECT 'MAD (mean)', avg(abs(y - v)) FROM o UNION ALL SELECT 'Correlation', corr(y, v) FROM o UNION ALL SELECT 'Coverage (90% CI)', avg((y = v)::INT) FROM o)")
def compare_trajectories(spark: SparkSession, d: str) -> DataFrame:
    s = dynamics.simulate(spark, Equation("2 * z - z^2"), "z", 0.1, 0.05, 100)
    observed = s.select("t", (F.col("value") + 0.01 * (F.col("step") % 3)).alias("observed"))
    return rounded(dynamics.compare(observed, dynamics.fan(s)), "value")


def queries() -> dict[str, Query]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
