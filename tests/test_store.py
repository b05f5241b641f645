"""Storage, cleaning and universes on hand-made rows."""

import datetime

import numpy as np
import pandas as pd
import pytest

from barloom.operators import cleaning, universe
from barloom.operators.universe import Pool, Universe
from barloom.sources.store import Store, asof_factors, missing_spans

D = [datetime.date(2020, 1, k) for k in range(1, 11)]


def bars(spark, rows):
    return spark.createDataFrame(rows, "code string, date date, close double, volume double")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert not s.exists("daily_bars") and s.read("daily_bars").count() == 0
    assert s.insert_or_ignore(bars(spark, [("a", D[0], 1.0, 5.0), ("a", D[0], 9.0, 9.0), ("b", D[1], 2.0, 6.0)]), "daily_bars") == 2
    assert s.insert_or_ignore(bars(spark, [("a", D[0], 7.0, 5.0), ("a", D[2], 3.0, 5.0)]), "daily_bars") == 1
    assert s.upsert(spark.createDataFrame([("a", D[0], 4.0), ("c", D[0], 5.0)], "code string, date date, close double"), "daily_bars") == 2
    got = {(r.code, r.date): (r.close, r.volume) for r in s.read("daily_bars").collect()}
    assert got == {("a", D[0]): (4.0, 5.0), ("b", D[1]): (2.0, 6.0), ("a", D[2]): (3.0, 5.0), ("c", D[0]): (5.0, None)}
    assert s.latest_date("daily_bars", "a") == D[2] and s.latest_date("daily_bars", "z") is None
    assert s.query("SELECT count(*) AS n FROM daily_bars WHERE close > ?", [2.5]).first().n == 3
    assert s.refresh_ranges() == 3 and {r.code: (r.data_start, r.data_end) for r in s.date_ranges().collect()}["a"] == (D[0], D[2])
    assert [r.date for r in s.daily(["a"], start=D[1]).collect()] == [D[2]] and s.trade_dates().count() == 3
    s.backfill()
    assert {r.code: r.pre_close for r in s.daily(["a"], start=D[1]).collect()} == {"a": 4.0}
    spans = missing_spans(spark.createDataFrame([("a",), ("z",), ("c",)], "code string"), s.date_ranges(), D[0], D[2])
    assert {r.code: r.from_date for r in spans.collect()} == {"z": D[0], "c": D[1]}
    s.truncate("daily_bars")
    assert s.exists("daily_bars") and s.read("daily_bars").count() == 0


def test_asof_factors(spark):
    got = asof_factors(bars(spark, [("a", d, 1.0, 1.0) for d in D[:5]]), spark.createDataFrame([("a", D[2], 2.0), ("a", D[4], 3.0)], "code string, date date, factor double"))
    assert [r.adj_factor for r in got.orderBy("date").collect()] == [1, 1, 2, 2, 3] and got.columns == ["code", "date", "close", "volume", "adj_factor"]


@pytest.mark.parametrize("method", ["ffill", "bfill", "interpolate"])
def test_fill(spark, method):
    x = [None, 1.0, None, None, 4.0, None]
    got = [r.close for r in cleaning.fill_missing(bars(spark, [("a", D[k], v, 1.0) for k, v in enumerate(x)]), method, ["close"]).orderBy("date").collect()]
    p = pd.Series(x, dtype=float)
    want = {"ffill": p.ffill().bfill(), "bfill": p.bfill(), "interpolate": p.interpolate().bfill()}[method]
    np.testing.assert_allclose(np.array(got, float), want)


def test_cleaning(spark):
    df = spark.createDataFrame([("a", "2020-01-01", "1.5", 10.0, 100.0), ("a", "bad", "x", 10.0, 100.0), ("b", "2020-01-01", "2", 0.0, 1.0)], "code string, date string, close string, volume double, amount double")
    rows = cleaning.standardise_columns(df).collect()
    assert [(r.date, r.close) for r in rows] == [(D[0], 1.5), (None, None), (D[0], 2.0)]
    assert {r.code for r in cleaning.drop_invalid(cleaning.standardise_columns(df)).collect()} == {"b"}
    assert cleaning.missing_vwap(df).where("code = 'a'").first().vwap == 10.0 and cleaning.remove_suspended(df).count() == 2
    moves = spark.createDataFrame([(0.05,), (-0.2,)], "pct_change double")
    assert cleaning.outliers(moves).count() == 1 and cleaning.outliers(moves.union(spark.createDataFrame([(5.0,), (12.0,)], "pct_change double"))).count() == 1
    daily = cleaning.standardise_daily(spark.createDataFrame([("2020-01-01", 10.0, 2.0, 5.0, 2000.0)], "day string, close double, vol double, pct_change double, amount double"), "000001", {"day": "date", "vol": "volume"}, lots=True).first()
    assert daily.volume == 200 and daily.pre_close == pytest.approx(10 / 1.05) and daily.vwap == pytest.approx(10.0) and daily.adj_factor == 1
    adj = spark.createDataFrame([("a", 10.0, 1.0), ("a", 10.0, 2.0)], "code string, close double, adj_factor double")
    assert [r.close for r in cleaning.adjust(adj, "qfq").orderBy("adj_factor").collect()] == [5.0, 10.0] and [r.close for r in cleaning.adjust(adj).orderBy("adj_factor").collect()] == [10.0, 20.0]
    checks = cleaning.price_checks(spark.createDataFrame([("a", D[0], 1.0, 1.0, 2.0, 0.0), ("a", D[1], 3.0, 1.0, 2.0, 1.5)], "code string, date date, vwap double, low double, high double, close double").withColumn("pre_close", cleaning.F.lit(5.0))).first()
    assert (checks.n_rows, checks.n_not_positive, checks.n_vwap_outside) == (2, 1, 1)


def test_universe(spark):
    info = spark.createDataFrame([("600001", "one", "x", D[0], None, 1), ("600002", "*ST two", "x", D[0], None, 1), ("300001", "three", "", D[0], None, 1), ("300002", "four", "y", D[8], None, 1), ("688001", "five", "y", D[0], D[1], 1), ("000001", "six", "z", None, None, 0)], "code string, name string, industry string, list_date date, out_date date, status int")
    members = spark.createDataFrame([("000300", "600001"), ("000300", "300002")], "index_code string, code string")
    u, codes = Universe(info, members), lambda x: sorted(r.code for r in x.collect())
    assert codes(u.codes()) == ["300002", "600001", "688001"]
    assert codes(u.filter_st(False).filter_delisted(False).filter_empty_industry(False).codes()) == sorted(r.code for r in info.collect())
    assert codes(u.scope(Pool.CSI300, "sh688001").exclude(Pool.CHINEXT).codes()) == ["600001", "688001"]
    assert codes(u.scope(Pool.SH_MAIN).exclude(["600001"]).codes()) == [] and codes(u.exclude(Pool.ALL).codes()) == []
    assert codes(u.listed(D[2], D[4])) == ["600001"]
    days = bars(spark, [(c, d, 1.0, 1.0) for c in ("600001", "688001") for d in D])
    assert u.load(days, D[2], D[4]).count() == 3 and universe.summary(days).first().n_codes == 2
    assert universe.benchmark_code(Pool.CSI300) == "000300" and universe.benchmark_code("sh000016") == "000016"
    with pytest.raises(TypeError):
        u.scope(5)
    with pytest.raises(ValueError):
        universe.benchmark_code(Pool.STAR)
