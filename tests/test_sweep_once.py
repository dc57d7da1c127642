from driftloom.functions.equations import Equation
from driftloom.operators import dynamics


def test_points_of_draws_are_searched_once(spark):
    draws = spark.range(1, 6).selectExpr("id draw", "cast(id as double) a")
    found, _ = dynamics.analyse_bifurcations(spark, Equation("u + a - z"), "z", "u", -1.0, 1.0, 3, -10.0, 10.0, 41, draws=draws, n_draws=None)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.draw, r.u, round(r.fixed_point, 6)) for r in found.collect()) == sorted((d, u, u + d) for d in range(1, 6) for u in (-1.0, 0.0, 1.0))
