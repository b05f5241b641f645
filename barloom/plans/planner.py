"""Many factors in one plan: shared parts are computed once, one select a window layer.

Layers are staged: all row windows of a layer share one sort by (code, date), all
cross-sections one by date. Recursive means run per code as a grouped map.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.algebra import CROSS, RECURSIVE, Node, exponents, parse, windows
from barloom.operators.render import DUCK, SPARK, Renderer

KEYS = ["date", "code"]


def _layers(trees: list[Node]) -> tuple[dict[Node, str], dict[int, list[Node]]]:
    found: dict[Node, int] = {}
    for t in trees:
        windows(t, found)
    names = {n: f"w{k}" for k, n in enumerate(found)}
    by: dict[int, list[Node]] = {}
    for n, layer in found.items():
        by.setdefault(layer, []).append(n)
    return names, by


def _parted(nodes: list[Node]) -> list[list[Node]]:
    """Row windows, cross-sections, recursive means."""
    return [[n for n in nodes if n[0] not in CROSS | RECURSIVE], [n for n in nodes if n[0] in CROSS], [n for n in nodes if n[0] in RECURSIVE]]


def _ema(df: DataFrame, nodes: list[Node], names: dict[Node, str]) -> DataFrame:
    """The recursive mean of every code, gaps weighing as rows: one grouped map for all of a layer."""
    wanted = [(names[n], float(n[3][1]) / float(n[2][1])) for n in nodes]
    inputs = df.select("*", *[F.expr(Renderer(SPARK, names).value(n[1])).cast("double").alias(f"in_{names[n]}") for n in nodes])
    schema = df.schema.simpleString()[7:-1] + "".join(f",{w}:double" for w, _ in wanted)
    kept = df.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        for w, alpha in wanted:
            pdf[w] = pdf[f"in_{w}"].astype("float64").ewm(alpha=alpha, adjust=False).mean()
        return pdf[[*kept, *[w for w, _ in wanted]]]

    return inputs.groupBy("code").applyInPandas(fold, schema.replace(":", " "))


def c_power(x: pd.Series, y: pd.Series) -> pd.Series:
    """The C library's power, as DuckDB has it: the JVM's differs in the last bit. Rows without x give null."""
    out = np.full(len(x), np.nan)
    for k in np.flatnonzero(x.notna() & y.notna()):
        try:
            out[k] = math.pow(x.iat[k], y.iat[k])
        except (OverflowError, ValueError):  # beyond all doubles, or zero to a negative power
            out[k] = math.inf
    return pd.Series(out)


def cleaned(expression: str, dialect: str) -> str:
    """No infinities and NaNs in results."""
    return f"CASE WHEN abs({expression}) < CAST('Infinity' AS DOUBLE) THEN {expression} END"


def shown(v: str) -> str:
    """A result for comparison: fewer digits for larger values, and exact halves moved off the edge between two roundings."""
    return f"CASE WHEN abs({v}) < 1e4 THEN round({v} + CAST(2.5e-9 AS DOUBLE), 6) WHEN abs({v}) < 1e9 THEN round({v} + CAST(2.5e-4 AS DOUBLE), 1) WHEN abs({v}) < 1e15 THEN round({v} + 250, -5) ELSE {v} END + CAST(0 AS DOUBLE)"


def compute(bars: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """date, code and one column for each formula."""
    trees = {k: parse(f) for k, f in formulas.items()}
    names, by = _layers(list(trees.values()))
    raised = frozenset().union(*map(exponents, trees.values()))
    df = bars
    for layer in sorted(by):
        rows, cross, recursive = _parted(by[layer])
        for nodes in (rows, cross):
            if nodes:
                df = df.selectExpr("*", *[f"{Renderer(SPARK, names, exponents=raised).window(n)} AS {names[n]}" for n in nodes])
        if recursive:
            df = _ema(df, recursive, names)
    last = {k: f"CAST({Renderer(SPARK, names, 'barloom_c_power').value(t)} AS DOUBLE) AS {k}" for k, t in trees.items()}
    if any("barloom_c_power" in x for x in last.values()):
        df.sparkSession.udf.register("barloom_c_power", F.pandas_udf(c_power, "double"))
    out = df.selectExpr(*KEYS, *last.values())
    return out.selectExpr(*KEYS, *[f"{cleaned(k, SPARK)} AS {k}" for k in formulas])


def duck_sql(bars_sql: str, formulas: dict[str, str], rounded: bool = False) -> str:
    """The same factors as DuckDB SQL; recursive ones have none."""
    trees = {k: parse(f) for k, f in formulas.items()}
    names, by = _layers(list(trees.values()))
    steps, last = [f"s0 AS MATERIALIZED ({bars_sql})"], "s0"
    for layer in sorted(by):
        rows, cross, recursive = _parted(by[layer])
        if recursive:
            raise ValueError("recursive")
        for nodes in (rows, cross):
            if nodes:
                step = f"s{len(steps)}"
                steps.append(f"{step} AS MATERIALIZED (SELECT *, {', '.join(f'{Renderer(DUCK, names).window(n)} AS {names[n]}' for n in nodes)} FROM {last})")
                last = step
    steps.append(f"f AS (SELECT {', '.join(KEYS)}, {', '.join(f'CAST({Renderer(DUCK, names).value(t)} AS DOUBLE) AS {k}' for k, t in trees.items())} FROM {last})")
    out = f"SELECT {', '.join(KEYS)}, {', '.join(f'{cleaned(k, DUCK)} AS {k}' for k in formulas)} FROM f"
    return f"WITH {', '.join(steps)} " + (f"SELECT {', '.join(KEYS)}, {', '.join(f'{shown(k)} AS {k}' for k in formulas)} FROM ({out}) r" if rounded else out)
