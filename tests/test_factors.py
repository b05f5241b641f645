"""Factors against an independent engine and pandas."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.functions.algebra import parse
from barloom.plans import catalog, factors101, factors191
from barloom.plans.planner import compute, duck_sql

FORMULAS = {"a": "RANK(C)", "b": "CORR(C,V,6)", "c": "TSRANK(C,5)", "d": "DECAY(C,4)", "e": "ARGMAX(H,5)", "f": "SLOPE(C,5)", "g": "INDNEUT(C)", "h": "IF(C>DELAY(C,1),SUM(V,3),-1)", "i": "WMA(C,5)", "j": "PROD(C/O,3)"}


def panel(rows=30, codes=6):
    rng = np.random.default_rng(1)
    at = [(pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), j) for i in range(rows) for j in range(codes)]
    pdf = pd.DataFrame(at, columns=["date", "code"])
    for c in ("open", "high", "low", "close", "volume"):
        pdf[c] = rng.uniform(1, 9, len(pdf)).round(1)  # one digit: ties
    pdf["amount"] = pdf.close * pdf.volume
    pdf["vwap"], pdf["ret"], pdf["cap"], pdf["bm_close"], pdf["bm_open"] = pdf.close, pdf.open - 5, 1.0, pdf.close, pdf.open
    pdf["industry"] = (pdf.code % 2).astype("Int64")
    pdf.loc[rng.random(len(pdf)) < 0.1, "close"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def bars(spark):
    pdf = panel()
    rows = [tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in pdf.astype(object).itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "date timestamp, code long, open double, high double, low double, close double, volume double, amount double, vwap double, ret double, cap double, bm_close double, bm_open double, industry long")


def test_every_formula_parses():
    assert len(factors101.FORMULAS) == 101 and len(factors191.FORMULAS) == 191
    for f in catalog.FORMULAS.values():
        parse(f)


def test_power_binds_tighter_than_minus():
    assert parse("-C^2") == ("neg", ("pow", ("col", "close"), ("num", 2.0)))


def test_two_engines_agree(bars):
    pdf, df = bars
    ours = compute(df, FORMULAS).toPandas().sort_values(["date", "code"]).reset_index(drop=True)
    con = duckdb.connect()
    con.register("bars", pdf.astype({"industry": float}))
    theirs = con.sql(duck_sql("SELECT * REPLACE (CASE WHEN isnan(close) THEN NULL ELSE close END AS close) FROM bars", FORMULAS)).df().sort_values(["date", "code"]).reset_index(drop=True)
    for k in FORMULAS:
        np.testing.assert_allclose(ours[k].astype(float), theirs[k].astype(float), rtol=1e-9, atol=1e-9, err_msg=k)


def test_against_pandas(bars):
    pdf, df = bars
    got = compute(df, {"r": "RANK(C)", "m": "EMA(C,5,2)", "s": "STD(C,6)"}).toPandas().set_index(["date", "code"]).sort_index()
    wide = pdf.pivot(index="date", columns="code", values="close")
    for name, want in {"r": wide.rank(axis=1, pct=True), "m": wide.ewm(alpha=0.4, adjust=False).mean(), "s": wide.rolling(6, min_periods=3).std()}.items():
        np.testing.assert_allclose(got[name].unstack().astype(float), want, rtol=1e-9, err_msg=name)
