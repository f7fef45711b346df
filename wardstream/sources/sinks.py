"""Sinks: JSON, CSV, LaTeX tables, plotted data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardstream.runtime import bounded_rows
from wardstream.schema import FLOW_SCHEMA


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_flows(flows: DataFrame, path: str) -> None:
    """The flow log as headerless CSV, in the order that :func:`wardstream.sources.readers.read_flows` reads."""
    flows.select(*[f.name for f in FLOW_SCHEMA.fields]).write.mode("overwrite").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _cell(x) -> str:
    if x is None:
        return "--"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, int):
        return f"{x:,}"
    if isinstance(x, float):
        return f"{x:.4g}"
    out = str(x)
    for a in "&%$#_{}":
        out = out.replace(a, "\\" + a)
    return out


def latex(df: DataFrame, caption: str, label: str, most: int = 500) -> str:
    """A LaTeX table of a small result (more than ``most`` rows are an error)."""
    rows = bounded_rows(df, most, "a printed table")
    body = [" & ".join(_cell(x) for x in r) + r" \\" for r in rows]
    head = " & ".join(_cell(c) for c in df.columns) + r" \\"
    spec = "".join("r" if t in ("int", "bigint", "double", "float") else "l" for _, t in df.dtypes)
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{spec}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def plotted(df: DataFrame, x: str, series: list[str], path: str) -> None:
    """The data behind a figure, in long form and in order of x."""
    df.select(x, *series).unpivot([x], series, "series", "value").orderBy("series", x).write.mode("overwrite").parquet(path)
