"""Sinks: tables as Markdown, LaTeX and HTML, reports, JSON, and exports of results."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; nulls are written, infinite numbers and NaN become null."""
    clean = [F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def number(x: float | None, digits: int = 4) -> str:
    """Fixed notation between 0.001 and 10000, else scientific."""
    if x is None or math.isnan(x):
        return "NA"
    return f"{x:.{digits}f}" if x == 0 or 1e-3 <= abs(x) < 1e4 else f"{x:.{digits}e}"


def _cells(rows: Sequence, digits: int) -> list[list[str]]:
    return [[number(v, digits) if isinstance(v, float) else "" if v is None else str(v) for v in row] for row in rows]


def _rows(df: DataFrame, most: int) -> tuple[list[str], list]:
    """The first ``most`` rows, a report's length."""
    return df.columns, df.limit(most).collect()


def markdown(df: DataFrame, digits: int = 4, most: int = 50) -> str:
    names, rows = _rows(df, most)
    lines = [names, ["---"] * len(names), *_cells(rows, digits)]
    return "\n".join("| " + " | ".join(c.replace("|", r"\|") for c in line) + " |" for line in lines)


def latex(df: DataFrame, caption: str = "", label: str = "", digits: int = 4, most: int = 50) -> str:
    names, rows = _rows(df, most)
    escape = lambda c: c.replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&").replace("#", r"\#")
    body = " \\\\\n".join(" & ".join(map(escape, r)) for r in [names, *_cells(rows, digits)])
    return f"\\begin{{table}}[htbp]\n\\caption{{{escape(caption)}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{'l' * len(names)}}}\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}"


def html_table(df: DataFrame, digits: int = 4, most: int = 50) -> str:
    names, rows = _rows(df, most)
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line(names, "th") + "".join(line(r, "td") for r in _cells(rows, digits)) + "</table>"


def report(sections: dict[str, DataFrame], title: str = "Analysis", form: str = "markdown", digits: int = 4) -> str:
    """A text with one table per section, as markdown, html or latex."""
    if form == "markdown":
        return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{markdown(df, digits)}" for name, df in sections.items()) + "\n"
    if form == "html":
        return f"<html><body><h1>{html.escape(title)}</h1>" + "".join(f"<h2>{html.escape(n)}</h2>{html_table(df, digits)}" for n, df in sections.items()) + "</body></html>"
    if form == "latex":
        return "\\documentclass{article}\n\\begin{document}\n\\title{" + title + "}\\maketitle\n" + "\n".join(f"\\section{{{n}}}\n{latex(df, n, digits=digits)}" for n, df in sections.items()) + "\n\\end{document}\n"
    raise ValueError("form must be markdown, html or latex")


def export(results: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet", "csv")) -> list[str]:
    """Write each table as ``folder/name.format`` for parquet, csv and json; returns the paths."""
    paths = []
    for name, df in results.items():
        for form in formats:
            path = f"{folder}/{name}.{form}"
            if form == "csv":
                df.write.mode("overwrite").csv(path, header=True)
            else:
                getattr(df.write.mode("overwrite"), {"parquet": "parquet", "json": "json"}[form])(path)
            paths.append(path)
    return paths


