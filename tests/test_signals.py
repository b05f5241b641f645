"""Parsers and performance on hand-made payloads and curves."""

import datetime
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import performance, signals

D = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(400)]


def payload(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, payload string")


def test_quotes(spark):
    v = [str(k) for k in range(53)]
    v[1], v[39] = "name", ""
    got = signals.quotes(payload(spark, f'v_sh600519="{"~".join(v)}";\nv_sz1="a~b";', "nothing")).collect()
    assert [(r.code, r.name, r.price, r.pe_ttm, r.pe_static) for r in got] == [("600519", "name", 3.0, 0.0, 52.0)]


def test_lines_and_fields(spark):
    got = signals.fund_flow(payload(spark, json.dumps({"data": {"klines": ["2020-01-02,1,-,3,4,5,6", "short,1"]}}), "{}", "bad")).collect()
    assert [(r.date, r.main_net, r.small_net, r.super_net) for r in got] == [(D[1], 1.0, 0.0, 5.0)]
    assert payload(spark, 'var x="a,b,1"', "none").select(signals.quoted_fields().alias("f")).toPandas().f.map(list).tolist() == [["a", "b", "1"], []]
    row = spark.range(1).select(signals.pool_time(F.lit(92500)).alias("t"), signals.epoch_date(F.lit(1577808000000)).alias("d"), signals.plain_text(F.lit("<b>x</b>y")).alias("p"), signals.unwrapped(F.lit('cb({"a":1});')).alias("u"), signals.number_or_text(F.lit("x1")).alias("n")).first()
    assert (row.t, row.d, row.p, row.u, row.n.text) == ("09:25:00", D[0], "xy", '{"a":1}', "x1")


def test_reports(spark):
    data = {"result": {"data": [{"TRADE_DATE": "2020-01-02 00:00:00", "DEAL_PRICE": 11, "CLOSE_PRICE": 10, "BUYER_NAME": "b"}, {"TRADE_DATE": "2020-01-03", "CLOSE_PRICE": None}]}}
    got = signals.report_rows(payload(spark, json.dumps(data)), "block_trade").orderBy("date").collect()
    assert [(r.date, r.price, r.premium_pct, r.buyer, r.seller) for r in got] == [(D[1], 11.0, 10.0, "b", ""), (D[2], 0.0, 0.0, "", "")]
    rows = signals.report_rows(payload(spark, json.dumps({"result": {"data": [{"FREE_DATE": str(D[k])} for k in (0, 5, 60, 300)]}})), "lockup")
    assert {r.kind: r.n for r in signals.lockups(rows, D[5]).groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"history": 2, "upcoming": 1}


def test_pools(spark):
    pool = {"data": {"pool": [{"c": "1", "n": "x", "p": 12340, "zdp": 10.004, "hs": 1.236, "lbc": 2, "fbt": 92500, "lbt": 145900, "fund": 5, "zbc": 0, "zttj": {"days": 3, "ct": 2}}, {"c": "2", "lbc": 1}]}}
    got = signals.limit_pool(payload(spark, json.dumps(pool))).orderBy("code").collect()
    assert (got[0].price, got[0].pct, got[0].turnover, got[0].last_seal, got[0].zt_stat, got[1].zt_stat) == (12.34, 10.0, 1.24, "14:59:00", "3天2板", "?天?板")
    rows = [("up", 1, 10.0), ("up", 1, 10.0), ("up", 3, 10.0), ("broken", None, 5.0), ("yesterday", None, 9.9), ("yesterday", None, 2.0), ("yesterday", None, 9.8)]
    told = signals.sentiment(spark.createDataFrame([(D[0], *r) for r in rows], "date date, kind string, limit_days int, pct double")).first()
    assert (told.zt_count, told.break_rate, told.max_height, told.ladder, told.promotion_rate) == (3, 25.0, 3, {1: 2, 3: 1}, 66.7)


def test_articles_and_arrays(spark):
    rows = [(0, "u", "t", "2020-01-01", 1.0), (1, "u", "t2", "2020-01-02", 1.0), (2, "", "t", "2020-01-03", None), (3, None, "t", "2020-01-03", 2.0)]
    got = signals.dedup_articles(spark.createDataFrame(rows, "n int, uid string, title string, publish_date string, score double")).collect()
    assert [r.n for r in got] == [3, 0]
    zipped = signals.northbound(payload(spark, json.dumps({"time": ["9:30", "9:31", "9:32"], "hgt": [1.0, None], "sgt": [3.0, 4.0, 5.0]}), "{}"))
    assert [(r.time, r.hgt, r.sgt) for r in zipped.collect()] == [("9:30", 1.0, 3.0), ("9:31", None, 4.0)]
    snap = signals.daily_snapshot(zipped.withColumn("date", F.lit(D[1])), spark.createDataFrame([(D[0], 7.0, 8.0), (D[1], 0.0, 0.0)], "date date, hgt double, sgt double"))
    assert [tuple(r) for r in snap.collect()] == [(D[0], 7.0, 8.0), (D[1], 1.0, 4.0)]
    book = signals.order_book(spark.createDataFrame([("a", 1.0, 10, 20, 2.0, 30, 40)], "code string, bid1 double, bid_vol1 int, ask_vol1 int, bid2 double, bid_vol2 int, ask_vol2 int"), 2)
    assert [tuple(r) for r in book.collect()] == [("a", 1, 1.0, 10, 20), ("a", 2, 2.0, 30, 40)]


def test_valuation(spark):
    q = spark.createDataFrame([("a", "x", 100.0, 1.0, 2.0, 3.0), ("b", "y", 100.0, 1.0, 2.0, 3.0), ("c", "z", 100.0, 1.0, 2.0, 3.0)], "code string, name string, price double, mcap_yi double, pe_ttm double, pb double")
    e = spark.createDataFrame([("a", 2.0, 3.0, 5), ("b", -1.0, 1.0, 2)], "code string, eps_cur double, eps_next double, analyst_count int")
    got = {r.code: r for r in signals.valuation(q, e).collect()}
    assert (got["a"].pe_fwd, got["a"].cagr_pct, got["a"].peg, got["a"].digest_years) == (50.0, 50.0, 1.0, round(math.log(50 / 30) / math.log(1.5), 1))
    assert got["b"].pe_fwd == math.inf and got["b"].peg is None and got["c"].pe_fwd is None and got["c"].analyst_count == 0


def test_performance(spark):
    rng = np.random.default_rng(3)
    b = rng.normal(0, 0.01, 300)
    r = 0.5 * b + rng.normal(0, 0.005, 300)
    v = pd.Series(np.concatenate([[1.0], (1 + r).cumprod()]))
    curve = spark.createDataFrame([("x", D[k], float(v[k]), None if not k else float(b[k - 1])) for k in range(301)] + [("up", D[k], 1.0 + k, None) for k in range(3)], "run string, date date, value double, bench double")
    told = {x.run: x for x in performance.summary(curve).collect()}
    x, step = told["x"], v.pct_change().dropna()
    annual = v.iloc[-1] ** (252 / 301) - 1
    assert x.annual == pytest.approx(annual) and x.alpha == pytest.approx(annual - ((1 + b).prod() ** (252 / 300) - 1)) and x.beta == pytest.approx(np.cov(step, b)[0, 1] / b.var(ddof=1))
    assert x.drawdown == pytest.approx(((v.cummax() - v) / v.cummax()).max()) and x.var == pytest.approx(np.percentile(step, 5)) and x.sortino == pytest.approx((annual - 0.03) / (step[step < 0].std() * math.sqrt(252)))
    assert told["up"].sortino == math.inf and told["up"].beta == 1 and told["up"].duration == 0
    bent = performance.against_benchmark(curve.where("run = 'x'")).orderBy("date").toPandas()
    np.testing.assert_allclose(bent.cumulative_excess, (1 + step.to_numpy() - b).cumprod())
    k = 200
    beta = np.cov(step[k - 59 : k + 1], b[k - 59 : k + 1])[0, 1] / b[k - 59 : k + 1].var(ddof=1)
    assert bent.alpha[k] == pytest.approx(step.iloc[k] - beta * b[k])
    assert performance.monthly_returns(curve).count() == 2 and performance.report(performance.summary(curve)).count() == 2


def test_trades(spark):
    rows = [("x", 0, "a", D[1], "buy", 10.0, 100, 5.0), ("x", 1, "a", D[3], "sell", 12.0, 100, 6.0), ("x", 2, "a", D[4], "buy", 10.0, 100, 5.0), ("x", 3, "a", D[9], "sell", 9.0, 100, 5.0), ("x", 4, "b", D[2], "buy", 10.0, 100, 0.0), ("x", 5, "b", D[5], "sell", 11.0, 100, 0.0), ("x", 6, "b", D[6], "buy", 1.0, 100, 0.0)]
    trades = spark.createDataFrame(rows, "run string, seq int, code string, date date, direction string, price double, quantity long, commission double")
    paired = performance.pair_trades(trades)
    assert sorted((r.code, r.k, r.pnl, r.holding_days) for r in paired.collect()) == [("a", 1, 189.0, 2), ("a", 2, -110.0, 5), ("b", 1, 100.0, 3)]
    s = performance.trade_statistics(paired).first()
    assert (s.n_trades, s.n_wins, s.win_streak, s.loss_streak, s.win_days, s.loss_days) == (3, 2, 2, 1, 2.5, 5.0) and s.profit_factor == pytest.approx(289 / 110)
    curve = spark.createDataFrame([("x", D[k], 1.0 + 0.01 * k, 0.01) for k in range(12)], "run string, date date, value double, bench double")
    got = {(r.code, r.k): r.alpha_pnl for r in performance.trade_alpha(paired, curve).collect()}
    assert got[("a", 1)] == pytest.approx(189 - 1000 * (1.01**2 - 1))
    assert performance.trade_summary(trades).count() == 4
