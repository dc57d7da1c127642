"""Substitutions that move nothing, and draws that are not the model's, are refused by kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions.equations import Equation
from driftloom.functions.errors import EngineError, PredictionNondeterministic, SubstitutionIgnored, SubstitutionInert, UncertifiableSubstitution
from driftloom.operators import certify

FITTED = {"a": 1.0, "b": -2.0}


def line(c):
    return Equation("a + b * z", c).column()


@pytest.fixture
def points(spark):
    return spark.range(50).select((F.col("id") / 10).alias("z"), F.lit(0.0).alias("zero"))


def test_a_change_that_is_seen_and_one_that_is_none(points):
    certify.verify_substitution(points, line, FITTED, {"b": 3.0})
    certify.verify_substitution(points, lambda c: F.lit(1.0), FITTED, {"b": -2.0 - 1e-12})
    assert certify.effective({"a": 1.0, "b": -2.1, "c": 0.0}, FITTED) == {"b": -2.1, "c": 0.0}


def test_errors_have_their_kinds(points):
    z = F.col("z")
    design = {"a": F.lit(1.0), "b": z}
    with pytest.raises(SubstitutionIgnored, match="unchanged$"):
        certify.verify_substitution(points, lambda c: 1 - 2 * z, FITTED, {"b": 3.0}, design)
    with pytest.raises(SubstitutionIgnored, match="may be zero"):
        certify.verify_substitution(points, lambda c: 1 - 2 * z, FITTED, {"b": 3.0})
    with pytest.raises(SubstitutionInert):
        certify.verify_substitution(points, lambda c: F.lit(c["a"]) + F.lit(c["b"]) * F.col("zero"), FITTED, {"b": 3.0}, {"b": F.col("zero")})
    with pytest.raises(PredictionNondeterministic):
        certify.verify_substitution(points, lambda c: line(c) + F.rand(), FITTED, {"b": 3.0})
    with pytest.raises(UncertifiableSubstitution):
        certify.verify_substitution(points, lambda c: F.lit(float("nan")) * c["b"], FITTED, {"b": 3.0})
    with pytest.raises(UncertifiableSubstitution):
        certify.verify_substitution(points.limit(0), line, FITTED, {"b": 3.0})
    assert issubclass(SubstitutionInert, EngineError) and issubclass(PredictionNondeterministic, EngineError)


def test_draws_average_to_the_prediction_on_the_response_scale(spark, points):
    rng = np.random.default_rng(3)
    ab = rng.normal([0.1, 0.4], 0.2, (30, 2))
    draws = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(ab)], "draw int, a double, b double")
    z = F.col("z")
    design = {"a": F.lit(1.0), "b": z}
    mean = {"a": float(ab[:, 0].mean()), "b": float(ab[:, 1].mean())}
    assert certify.certify_draws(points, draws, design, line(mean)).error < 1e-12
    response = sum((F.exp(F.lit(float(a)) + F.lit(float(b)) * z) for a, b in ab[1:]), F.exp(F.lit(float(ab[0, 0])) + F.lit(float(ab[0, 1])) * z)) / 30
    row = certify.certify_draws(points, draws, design, response, F.exp)
    assert row.n == 50 and row.scale > 1
    with pytest.raises(UncertifiableSubstitution, match="differ"):
        certify.certify_draws(points, draws, design, F.exp(line(mean)), F.exp)
    with pytest.raises(UncertifiableSubstitution, match="draws of b"):
        certify.certify_draws(points, draws, {"a": F.lit(1.0)}, line(mean))
    with pytest.raises(UncertifiableSubstitution, match="no prediction"):
        certify.certify_draws(points, draws, design, F.lit(float("inf")))
    with pytest.raises(UncertifiableSubstitution):
        certify.certify_draws(points, draws.limit(0), design, line(mean))
