"""Equations as text: turned into Columns, numpy values, LaTeX, and parameterised forms.

The text is read with Python's own expression grammar (``^`` means power).
"""

from __future__ import annotations

import ast
import functools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import REGISTRY, divide

NUMBER = re.compile(r"-?\d+\.?\d*([eE][+-]?\d+)?")


@dataclass(frozen=True)
class Equation:
    """A right-hand side: its text, values of its free names, and what it predicts."""

    text: str
    coefficients: dict[str, float] = field(default_factory=dict)
    target: str | None = None

    @property
    def tree(self) -> ast.expr:
        return _parsed(self.text)

    def names(self) -> list[str]:
        """Variables and coefficients in order of first use, without function names."""
        called = {n.func.id for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        seen = [n.id for n in sorted((n for n in ast.walk(self.tree) if isinstance(n, ast.Name)), key=lambda n: n.col_offset)]
        return list(dict.fromkeys(x for x in seen if x not in called and x != "pi"))

    def variables(self, columns: list[str]) -> list[str]:
        return [n for n in self.names() if n in columns and n not in self.coefficients]

    def free(self, columns: list[str]) -> list[str]:
        """Names that are neither columns nor known coefficients."""
        return [n for n in self.names() if n not in columns and n not in self.coefficients]

    def column(self, bind: dict[str, Column] | None = None) -> Column:
        """The equation as a Column; coefficients come before columns, ``bind`` before both."""
        return _column(self.tree, {k: F.lit(float(v)) for k, v in self.coefficients.items()} | (bind or {}))

    def values(self, data: dict[str, np.ndarray], known: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Values on arrays; ``known`` shares those of equal parts between equations without coefficients on the same data."""
        with np.errstate(all="ignore"):
            return _values(self.tree, {"pi": np.pi} | data | self.coefficients, known)

    def complexity(self) -> int:
        """Number of constants, variables and operations."""
        called = {id(n.func) for n in ast.walk(self.tree) if isinstance(n, ast.Call)}
        return sum(isinstance(n, (ast.Constant, ast.Name, ast.BinOp, ast.UnaryOp, ast.Call)) and id(n) not in called for n in ast.walk(self.tree))

    def latex(self, precision: int = 3) -> str:
        return _latex(self.tree, self.coefficients, precision)[0]

    def filled(self, digits: int = 4) -> str:
        """The text with coefficient values in place of their names."""
        return re.sub(r"\b[A-Za-z_]\w*\b", lambda m: f"{self.coefficients[m[0]]:.{digits}f}" if m[0] in self.coefficients else m[0], self.text)

    def parameterised(self, columns: list[str] = (), prefix: str = "c", keep_exponents: bool = True) -> Equation:
        """Numbers replaced by names c1, c2, ... from left to right, with the numbers as their values.

        A sign before a number belongs to it; whole exponents stay as they are.
        """
        taken, found = {*columns, *self.names(), *REGISTRY}, {}

        def fresh() -> str:
            i = 1
            while f"{prefix}{i}" in taken:
                i += 1
            taken.add(f"{prefix}{i}")
            return f"{prefix}{i}"

        class Names(ast.NodeTransformer):
            def visit_UnaryOp(self, node: ast.UnaryOp):
                if isinstance(node.op, (ast.USub, ast.UAdd)) and isinstance(node.operand, ast.Constant):
                    return self.name(-node.operand.value if isinstance(node.op, ast.USub) else node.operand.value)
                return self.generic_visit(node)

            def visit_Constant(self, node: ast.Constant):
                return self.name(node.value)

            def visit_BinOp(self, node: ast.BinOp):
                node.left = self.visit(node.left)
                whole = isinstance(node.op, ast.Pow) and isinstance(node.right, ast.Constant) and float(node.right.value).is_integer()
                if not (whole and keep_exponents):
                    node.right = self.visit(node.right)
                return node

            def name(self, value: float):
                new = fresh()
                found[new] = float(value)
                return ast.Name(id=new, ctx=ast.Load())

        tree = Names().visit(ast.parse(self.text.strip().replace("^", "**"), mode="eval"))
        return Equation(ast.unparse(tree).replace("**", "^"), {**self.coefficients, **found}, self.target) if found else self


@functools.lru_cache(maxsize=4096)
def _parsed(text: str) -> ast.expr:
    return ast.parse(text.strip().replace("^", "**"), mode="eval").body


def structure(text: Column) -> Column:
    """Equation text with every number as C: equal for equations that differ in constants only."""
    return F.regexp_replace(text, r"-?\d+\.?\d*([eE][+-]?\d+)?", "C")


def _column(node: ast.expr, bind: dict[str, Column]) -> Column:
    go = lambda n: _column(n, bind)
    match node:
        case ast.Constant():
            return F.lit(float(node.value))
        case ast.Name():
            if node.id in bind:
                return bind[node.id]
            return F.lit(float(np.pi)) if node.id == "pi" else F.col(node.id).cast("double")
        case ast.UnaryOp(op=ast.USub()):
            return -go(node.operand)
        case ast.UnaryOp(op=ast.UAdd()):
            return go(node.operand)
        case ast.BinOp(op=ast.Add()):
            return go(node.left) + go(node.right)
        case ast.BinOp(op=ast.Sub()):
            return go(node.left) - go(node.right)
        case ast.BinOp(op=ast.Mult()):
            return go(node.left) * go(node.right)
        case ast.BinOp(op=ast.Div()):
            return divide(go(node.left), go(node.right))
        case ast.BinOp(op=ast.Pow()):
            base = go(node.left)
            if isinstance(node.right, ast.Constant) and node.right.value in (2, 3):
                return base * base if node.right.value == 2 else base * base * base
            return F.pow(base, go(node.right))
        case ast.Call(func=ast.Name()) if node.func.id in REGISTRY:
            return REGISTRY[node.func.id].column(*map(go, node.args))
    raise ValueError(f"cannot read this part of an equation: {ast.unparse(node)}")


def _values(node: ast.expr, bind: dict, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """``known`` keeps the values of every part, by its text, for other equations on the same data."""
    if known is None or isinstance(node, (ast.Constant, ast.Name)):
        return _value(node, bind, known)
    name = _spelled(node)
    if name not in known:
        known[name] = _value(node, bind, known)
    return known[name]


def _spelled(node: ast.expr) -> str:
    if not hasattr(node, "spelled"):
        node.spelled = ast.unparse(node)
    return node.spelled


def _value(node: ast.expr, bind: dict, known: dict[str, np.ndarray] | None) -> np.ndarray:
    go = lambda n: _values(n, bind, known)
    match node:
        case ast.Constant():
            return np.float64(node.value)
        case ast.Name():
            return np.asarray(bind[node.id], dtype=float)
        case ast.UnaryOp():
            return -go(node.operand) if isinstance(node.op, ast.USub) else go(node.operand)
        case ast.BinOp():
            a, b = go(node.left), go(node.right)
            return {ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Div: np.divide, ast.Pow: np.power}[type(node.op)](a, b)
        case ast.Call():
            return REGISTRY[node.func.id].array(*map(go, node.args))
    raise ValueError(f"cannot read this part of an equation: {ast.unparse(node)}")


def _latex(node: ast.expr, coefficients: dict[str, float], digits: int) -> tuple[str, int]:
    """LaTeX and binding strength (3: atom, 2: product, 1: sum)."""
    go = lambda n: _latex(n, coefficients, digits)

    def wrap(n: ast.expr, least: int) -> str:
        text, strength = go(n)
        return text if strength >= least else rf"\left({text}\right)"

    match node:
        case ast.Constant():
            v = float(node.value)
            mantissa, _, exponent = f"{v:.{digits}e}".partition("e")
            plain = v == 0 or 1e-3 <= abs(v) < 1e4
            return (f"{v:.{digits}f}".rstrip("0").rstrip(".") if plain else rf"{float(mantissa):g} \times 10^{{{int(exponent)}}}"), 3
        case ast.Name():
            return go(ast.Constant(coefficients[node.id])) if node.id in coefficients else (node.id.replace("_", r"\_"), 3)
        case ast.UnaryOp():
            return ("-" if isinstance(node.op, ast.USub) else "") + wrap(node.operand, 2), 1
        case ast.BinOp(op=ast.Add()):
            return f"{wrap(node.left, 1)} + {wrap(node.right, 1)}", 1
        case ast.BinOp(op=ast.Sub()):
            return f"{wrap(node.left, 1)} - {wrap(node.right, 2)}", 1
        case ast.BinOp(op=ast.Mult()):
            return rf"{wrap(node.left, 2)} \cdot {wrap(node.right, 2)}", 2
        case ast.BinOp(op=ast.Div()):
            return rf"\frac{{{go(node.left)[0]}}}{{{go(node.right)[0]}}}", 3
        case ast.BinOp(op=ast.Pow()):
            return f"{{{wrap(node.left, 3)}}}^{{{go(node.right)[0]}}}", 3
        case ast.Call():
            return REGISTRY[node.func.id].latex.format(*(go(a)[0] for a in node.args)), 3
    raise ValueError(f"cannot read this part of an equation: {ast.unparse(node)}")
