"""Does a substitution reach the prediction, and do draws average to it? One aggregation for each question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.errors import PredictionNondeterministic, SubstitutionIgnored, SubstitutionInert, UncertifiableSubstitution

CLOSE = 1.5e-8


def effective(values: dict[str, float], fitted: dict[str, float]) -> dict[str, float]:
    """The values that differ from what was fitted, by over 1.5e-8 of it."""
    return {k: v for k, v in values.items() if k not in fitted or abs(v - fitted[k]) > CLOSE * (abs(fitted[k]) or 1.0)}


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def verify_substitution(points: DataFrame, predicted: Callable[[dict[str, float]], Column], fitted: dict[str, float], values: dict[str, float], design: dict[str, Column] | None = None) -> None:
    """Stop unless the values move a prediction at some of the ``points``.

    ``predicted`` gives the prediction under coefficients. It is asked for twice as fitted,
    as one that is not reproducible proves nothing, and once with the values. Values equal
    to the fitted ones are no change and are not tried. ``design`` gives the columns that
    coefficients multiply, to tell a term that is zero everywhere from one that is ignored.
    """
    tried = effective(values, fitted)
    if not tried:
        return
    first, again, moved = (_finite(predicted(c).cast("double")) for c in (fitted, fitted, {**fitted, **tried}))
    rows = points.select(first.alias("_1"), again.alias("_2"), moved.alias("_3"), *[(design[k].cast("double") != 0).alias(f"_x{i}") for i, k in enumerate(tried) if design and k in design])
    gap = F.sum(F.abs(F.col("_1") - F.col("_2")))
    unlike = (gap > CLOSE * F.sum(F.abs("_1"))) | (F.count_if(F.col("_1").isNull() != F.col("_2").isNull()) > 0)
    used = [c for c in rows.columns if c.startswith("_x")]
    got = rows.agg(F.count("_1").alias("finite"), F.coalesce(unlike, F.lit(False)).alias("unlike"), F.count_if(F.col("_1") != F.col("_3")).alias("moved"), *[F.count_if(c).alias(c) for c in used]).first()
    names = ", ".join(tried)
    if got["unlike"]:
        raise PredictionNondeterministic("the same prediction, made twice, gave different values")
    if got["moved"]:
        return
    if not got["finite"]:
        raise UncertifiableSubstitution(f"no prediction is finite, so whether {names} took effect cannot be established")
    if used and not any(got[c] for c in used):
        raise SubstitutionInert(f"{names} multiplies a term that is zero at every point")
    raise SubstitutionIgnored(f"{names} left every prediction unchanged" + ("" if used else "; the terms are not known, so they may be zero everywhere"))


def certify_draws(points: DataFrame, draws: DataFrame, design: dict[str, Column], predicted: Column, inverse_link: Callable[[Column], Column] = lambda c: c, tolerance: float = 1e-8) -> Row:
    """Stop unless predictions by draw, averaged, are ``predicted`` at the ``points``; returns n, error and scale.

    ``draws`` has ``draw`` and a column for each coefficient, ``design`` the column that each
    one multiplies, over ``points``, a search grid that is broadcast. The link is undone by
    draw, before the average. The error may be ``tolerance`` times the largest prediction,
    or of one if that is less.
    """
    names = [c for c in draws.columns if c != "draw"]
    missing = [c for c in names if c not in design]
    if missing or not names:
        raise UncertifiableSubstitution(f"draws of {', '.join(missing) or 'nothing'}, for which the design has no column")
    x = [f"_x{i}" for i in range(len(names))]
    grid = points.select(predicted.cast("double").alias("_want"), *[design[c].cast("double").alias(n) for c, n in zip(names, x, strict=True)])
    b = draws.select(*[F.col(c).cast("double").alias(f"_b{i}") for i, c in enumerate(names)])
    each = sum((F.col(n) * F.col(f"_b{i}") for i, n in enumerate(x[1:], 1)), F.col(x[0]) * F.col("_b0"))
    means = b.crossJoin(F.broadcast(grid)).groupBy("_want", *x).agg(F.avg(inverse_link(each)).alias("_got"))
    want, got = _finite(F.col("_want")), _finite(F.col("_got"))
    row = means.agg(F.count(want).alias("finite"), F.count(want + got).alias("n"), F.max(F.abs(want - got)).alias("error"), F.greatest(F.lit(1.0), F.max(F.abs(F.when(got.isNotNull(), want)))).alias("scale")).first()
    if not row.n:
        raise UncertifiableSubstitution("no prediction is finite" if not row.finite else "no average of the draws is finite where the prediction is")
    if not row.error <= tolerance * row.scale:
        raise UncertifiableSubstitution(f"averaged draws differ from the prediction by {row.error:.3g}, tolerance {tolerance * row.scale:.3g}")
    return row
