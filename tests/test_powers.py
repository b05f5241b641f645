"""Large powers have the digits of the C library."""

import math

import duckdb
import numpy as np
import pyarrow as pa

from barloom.plans.planner import compute, duck_sql


def test_large_powers(spark):
    rng = np.random.default_rng(3)
    rows = [(d, d, float(x), float(y)) for d, (x, y) in enumerate(zip(rng.uniform(0.001, 0.9, 2000), rng.uniform(-90, 3, 2000)))] + [(2000, 2000, 0.001, -900.0), (2001, 2001, None, 2.0)]
    got = {r.code: r.value for r in compute(spark.createDataFrame(rows, "date int, code int, close double, open double"), {"value": "SPOW(C,O)"}).collect()}
    large = [(k, math.pow(x, y)) for k, _, x, y in rows[:2000] if x**y >= 1e15]
    assert len(large) > 300 and [got[k] for k, _ in large] == [v for _, v in large]
    assert got[2000] is None and got[2001] is None


def test_powers_of_correlations_with_gaps(spark):
    """Gaps in one series make a correlation that is none, and its powers show all digits."""
    rng = np.random.default_rng(5)
    rows = [(d, c, float(x), None if gap else float(y), float(v)) for d in range(60) for c, (x, y, v, gap) in enumerate(zip(rng.uniform(1, 9, 150), rng.uniform(970, 1030, 150), rng.uniform(1, 50, 150).cumsum(), rng.random(150) < 0.4))]
    formulas = {"value": "-SPOW(RANK(C),CORR(O,MEAN(V,12),6))"}
    got = {(r.date, r.code): r.value for r in compute(spark.createDataFrame(rows, "date int, code int, close double, open double, volume double"), formulas).collect()}
    con = duckdb.connect()
    con.register("bars", pa.table(dict(zip(("date", "code", "close", "open", "volume"), map(pa.array, zip(*rows))))))
    want = {(d, c): v for d, c, v in con.sql(duck_sql("SELECT * FROM bars", formulas)).fetchall() if v is not None and abs(v) >= 1e15}
    assert len(want) > 300 and {k: got[k] for k in want} == want
