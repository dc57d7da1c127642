"""Scalar functions with IEEE results (infinities and NaN) where ANSI mode would raise or give null.

Each entry of REGISTRY is one function of equations: how it is built as a Column, how it is
computed on numpy arrays, its LaTeX pattern and its weight in an equation's complexity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    """a / b with a / 0 = signed infinity, and 0 / 0 = NaN."""
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))).otherwise(a / F.when(b != 0, b))


def ln(x: Column) -> Column:
    """Natural logarithm with ln(0) = -infinity and NaN below."""
    return F.when(x > 0, F.ln(F.when(x > 0, x))).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def inverse(x: Column) -> Column:
    return divide(F.lit(1.0), x)


def logistic(x: Column, k: Column | float = 1.0, x0: Column | float = 0.0) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(k) if isinstance(k, float) else k) * (x - x0)))


def threshold(x: Column, c: Column) -> Column:
    return F.when(x > c, F.lit(1.0)).when(x <= c, F.lit(0.0))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(x))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null: what aggregates should see."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def safe_divide(x: Column, y: Column, floor: float = 1e-10) -> Column:
    """Division that keeps the divisor's size above ``floor``."""
    return x / F.greatest(F.abs(y), F.lit(floor)) * F.signum(y + floor)


@dataclass(frozen=True)
class Function:
    column: Callable[..., Column]
    array: Callable[..., np.ndarray]
    latex: str
    complexity: int = 1


REGISTRY: dict[str, Function] = {
    "exp": Function(F.exp, np.exp, r"e^{{{0}}}"),
    "log": Function(ln, np.log, r"\ln\left({0}\right)"),
    "sqrt": Function(F.sqrt, np.sqrt, r"\sqrt{{{0}}}"),
    "sin": Function(F.sin, np.sin, r"\sin\left({0}\right)"),
    "cos": Function(F.cos, np.cos, r"\cos\left({0}\right)"),
    "tan": Function(F.tan, np.tan, r"\tan\left({0}\right)"),
    "asin": Function(F.asin, np.arcsin, r"\arcsin\left({0}\right)"),
    "acos": Function(F.acos, np.arccos, r"\arccos\left({0}\right)"),
    "atan": Function(F.atan, np.arctan, r"\arctan\left({0}\right)"),
    "sinh": Function(F.sinh, np.sinh, r"\sinh\left({0}\right)"),
    "cosh": Function(F.cosh, np.cosh, r"\cosh\left({0}\right)"),
    "tanh": Function(F.tanh, np.tanh, r"\tanh\left({0}\right)"),
    "abs": Function(F.abs, np.abs, r"\left|{0}\right|"),
    "sign": Function(F.signum, np.sign, r"\operatorname{{sgn}}\left({0}\right)"),
    "inv": Function(inverse, lambda x: 1.0 / x, r"\frac{{1}}{{{0}}}"),
    "square": Function(lambda x: x * x, np.square, r"\left({0}\right)^{{2}}"),
    "logistic": Function(logistic, lambda x, k=1.0, x0=0.0: 1 / (1 + np.exp(-k * (x - x0))), r"\sigma\left({0}\right)"),
    "threshold": Function(threshold, lambda x, c: (x > c).astype(float), r"\mathbf{{1}}\left[{0} > {1}\right]"),
    "softplus": Function(softplus, lambda x: np.logaddexp(0.0, x), r"\ln\left(1+e^{{{0}}}\right)"),
    "relu": Function(relu, lambda x: np.maximum(0.0, x), r"\max\left(0, {0}\right)"),
}


def define_operator(name: str, column: Callable[..., Column], array: Callable[..., np.ndarray], latex: str | None = None, complexity: int = 1) -> None:
    """Add a function that equations may call by ``name``."""
    REGISTRY[name] = Function(column, array, latex or rf"\operatorname{{{{{name}}}}}\left({{0}}\right)", complexity)
