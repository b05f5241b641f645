"""Runs over a stream of dates against the fold in memory."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.backtest import engine, strategies


def day(k):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=k)


def panel(rows=60, late=25):
    """Codes c and d begin late, and the factor is missing on some dates."""
    rng = np.random.default_rng(7)
    close = np.abs(rng.normal(0, 0.5, (rows, 4)).cumsum(axis=0)) + 5
    factor = rng.normal(0, 1, (rows, 4)).round(1)
    close[:late, 2:], factor[:late, 2:], factor[8:14] = np.nan, np.nan, np.nan
    cells = [(day(k), c, *(None if np.isnan(x) else float(x) for x in (close[k, j], factor[k, j]))) for k in range(rows) for j, c in enumerate("abcd") if k >= late or j < 2]
    return close, factor, cells


@pytest.fixture
def bars(spark):
    return spark.createDataFrame(panel()[2], "date date, code string, close double, factor double")


def test_nothing_is_read_before_the_result_is(spark):
    bars = spark.range(1).select(F.expr("CAST(raise_error('read') AS DATE)").alias("date"), F.lit("a").alias("code"), F.lit(1.0).alias("close"))
    assert engine.run_all(bars, engine.grid(spark, "dual_average", short=[3], long=[10])).columns[0] == "run"


def test_no_limit_on_cells(spark, bars, monkeypatch):
    monkeypatch.setattr(engine, "MOST_CELLS", 1, raising=False)
    got = engine.run_all(bars, engine.grid(spark, "top_factor", top=[1], every=[1]), ["close", "factor"], trades=True)
    assert got.count() > 0


@pytest.mark.parametrize("strategy, values", [("dual_average", {"short": [2, 3], "long": [4, 8]}), ("top_factor", {"top": [1, 2, 3], "every": [1, 4]})])
def test_streamed_runs_equal_the_fold(spark, bars, strategy, values):
    close, factor, _ = panel()
    runs = engine.grid(spark, strategy, **values)
    equity = engine.run_all(bars, runs, ["close", "factor"]).toPandas()
    log = engine.run_all(bars, runs, ["close", "factor"], trades=True).toPandas()
    for r in runs.collect():
        params = dict((k, int(v)) for k, v in (x.split("=") for x in r.run.split(",")))
        want, trades = engine.fold(strategies.create(strategy, **params), [day(k) for k in range(60)], list("abcd"), {"close": close, "factor": factor}, 1e6)
        np.testing.assert_array_equal(equity[equity.run == r.run].sort_values("date").value, [e[1] for e in want])
        got = log[log.run == r.run].sort_values("seq")
        assert list(zip(got.date, got.code, got.direction, got.quantity)) == [(t[0], t[1], t[2], t[4]) for t in trades]
    assert len(log) > 0


def test_past_keeps_what_is_asked_for():
    past = engine.Past(["close"], 3)
    for k in range(100):
        bar = past.push(day(k), pa.array(["a", "b"]), {"close": np.array([float(k), np.nan])})
    assert len(past.held["close"]) < 20 and bar.history("close", 3)[:, 0].tolist() == [97, 98, 99]
    with pytest.raises(ValueError):
        bar.history("close")
    with pytest.raises(ValueError):
        past.push(day(100), pa.array(["a", "a"]), {"close": np.array([1.0, 2.0])})


def test_any_text_is_a_code(spark):
    codes = sorted(["", '"', "\\", "\n", "\0", "a,b", "\u00e9", "\U0001f600"])
    bars = spark.createDataFrame([(day(k), c, 10.0, 1.0) for k in range(2) for c in codes], "date date, code string, close double, factor double")
    log = engine.run_all(bars, engine.grid(spark, "top_factor", top=[len(codes)], every=[1]), ["close", "factor"], trades=True)
    assert sorted({r.code for r in log.collect()}) == codes


def test_codes_are_one_text_a_date(spark, bars):
    assert dict(engine.packed(bars, ["close"]).dtypes)["code"] == "string"
