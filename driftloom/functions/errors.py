"""Errors by kind, all under one base, for callers that record some and stop at others."""

from __future__ import annotations


class EngineError(ValueError):
    """Any request that cannot be carried out as it stands."""


class UndeclaredName(EngineError):
    """The equation has a name that is neither the variable, nor a coefficient, nor given a value."""


class NameCollision(EngineError):
    """A name is declared in two roles."""


class UnknownName(EngineError):
    """A value is given for a coefficient, a parameter or a draw that the equation does not have."""


class SubstitutionIgnored(EngineError):
    """A value was given that the equation's result does not depend on."""


class SubstitutionInert(EngineError):
    """A value was given for a coefficient whose term is zero at every point."""


class PredictionNondeterministic(EngineError):
    """The same prediction, made twice, gave different values."""


class UncertifiableSubstitution(EngineError):
    """It cannot be shown that a substitution, or a prediction rebuilt from draws, is that of the fitted model."""
