"""The fold by hand-made cases, and its distribution against single runs."""

import datetime

import numpy as np
import pytest

from barloom.backtest import engine, risk, strategies
from barloom.backtest.broker import Account, Broker, Costs, Events, Order


def day(k):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=k)


def broker(cash=100_000.0, price=10.0):
    account = Account(cash)
    account.mark({"a": price})
    return account, Broker(account)


def test_buy_sell_and_the_next_day_rule():
    account, b = broker()
    assert b.process(Order("a", True, 1050))
    p = account.position("a")
    assert (p.quantity, p.frozen) == (1000, 1000) and p.cost == pytest.approx(10.02)
    assert account.cash == pytest.approx(100_000 - 10_020 - 5)
    assert not b.process(Order("a", False, 1000))
    b.new_day()
    assert b.process(Order("a", False, 500)) and account.position("a").quantity == 500
    assert account.cash == pytest.approx(100_000 - 10_025 + 4990 - 5 - 4.99)
    assert [t[2] for t in b.trades] == ["buy", "sell"]


def test_orders_shrink_to_cash_and_odd_lots_stay():
    account, b = broker(cash=2500)
    assert b.process(Order("a", True, 1000)) and account.position("a").quantity == 200
    account.positions["a"].quantity, account.positions["a"].frozen = 250, 0
    assert b.process(Order("a", False, 250)) and account.position("a").quantity == 50
    assert not b.process(Order("a", False, 50)) and not b.process(Order("z", True, 100))
    assert Broker(account, Costs(slippage=0)).fill_price(Order("a", True, 100, limit=9.0)) == 9.0


@pytest.mark.parametrize("cash", [3.3e5, 3.3e17, 3.3e24, 3.3e40])
def test_lots_that_a_large_cash_pays_for(cash):
    """Counting down by lots would not end where a lot less costs the same."""
    account = Account(cash)
    broker = Broker(account, Costs(commission=1e-9, slippage=0.0))
    account.mark({"a": 1234.5})
    most = int(cash / (1234.5 * (1 + 1e-9))) // 100
    order = Order("a", True, 10**60)

    class Counted(float):
        n = 0

        def __mul__(self, other):
            Counted.n += 1
            assert Counted.n < 10_000, "counts down"
            return float(self) * other

    broker.fill_price = lambda o: Counted(1234.5)
    assert broker.process(order) and account.cash >= 0
    assert order.quantity % 100 == 0 and 0 <= most - order.quantity // 100 <= 1 + most * 1e-15


def test_stops_and_levels():
    account, b = broker()
    b.process(Order("a", True, 1000))
    p, s = account.position("a"), risk.StopLoss()
    assert s.check(p, 10.0) == "" and s.check(p, 9.2) == "stop_loss" and s.check(p, 12.1) == "take_profit"
    t = risk.StopLoss(kind="trailing", take=None)
    assert t.check(p, 15.0) == "" and t.check(p, 13.6) == "" and t.check(p, 13.5) == "stop_loss"
    assert risk.StopLoss(kind="atr").check(p, 9.0, atr=0.5) == "stop_loss"
    m = risk.RiskMonitor()
    assert [m.update(v) for v in (100, 97, 95.9, 93, 90, 100)] == ["GREEN", "GREEN", "YELLOW", "ORANGE", "RED", "GREEN"]
    assert risk.buy_amount(account, "a", 1e9) == pytest.approx(0.25 * account.value - p.value)


def test_events_come_in_order():
    seen, events = [], Events()
    events.register("fill", lambda x: seen.append(("one", x)))
    events.register("fill", lambda x: seen.append(("two", x)))
    events.emit("fill", 1)
    assert seen == [("one", 1), ("two", 1)]
    with pytest.raises(ValueError):
        events.register("other", print)


class Once(strategies.Strategy):
    def handle_bar(self, bar):
        assert len(bar.history("close")) == (bar.date - day(0)).days + 1
        if bar.date == day(2):
            self.order_target_percent("a", 0.5)
        if bar.date == day(4):
            self.sell("a", self.account.position("a").quantity)


def test_fold():
    close = np.array([[10.0], [10], [10], [12], [12], [np.nan]])
    equity, trades = engine.fold(Once(), [day(k) for k in range(6)], ["a"], {"close": close}, 10_000.0, start=day(1))
    assert [e[0] for e in equity] == [day(k) for k in range(1, 6)] and [t[2] for t in trades] == ["buy", "sell"]
    cash = 10_000 - 500 * 10.02 - 5
    assert equity[2][1] == pytest.approx(cash + 500 * 12)
    assert equity[-1][1] == pytest.approx(cash + 500 * 12 * 0.998 * 0.999 - 5)


def test_grid_runs_equal_single_runs(spark):
    rng = np.random.default_rng(5)
    close = np.abs(rng.normal(0, 0.5, (80, 4)).cumsum(axis=0)) + 5
    rows = [(day(k), c, float(close[k, j])) for k in range(80) for j, c in enumerate("abcd")]
    bars = spark.createDataFrame(rows, "date date, code string, close double")
    runs = engine.grid(spark, "dual_average", short=[3, 5, 20], long=[10, 20])
    assert runs.count() == 4
    got = engine.run_all(bars, runs).toPandas()
    for short, long in ((3, 10), (3, 20), (5, 10), (5, 20)):
        equity, _ = engine.fold(strategies.create("dual_average", short=short, long=long), [day(k) for k in range(80)], list("abcd"), {"close": close}, 1e6)
        part = got[got.run == f"short={short},long={long}"].sort_values("date")
        np.testing.assert_allclose(part.value, [e[1] for e in equity])
    assert engine.run_all(bars, runs, trades=True).count() > 0
    told = engine.summary(engine.run_all(bars, runs)).toPandas()
    assert len(told) == 4 and told.sharpe.is_monotonic_decreasing
    literal = engine.run_all(bars, engine.grid(spark, "dual_average", literal=[True]), trades=True)
    assert literal.count() == 0


def test_regimes(spark):
    prices = [(1, day(k), 100.0 + k * 0.1) for k in range(300)] + [(2, day(k), 100.0 + (k % 2) * 0.01 - (3.0 * (k - 290) if k > 290 else 0)) for k in range(300)]
    got = risk.regimes(spark.createDataFrame(prices, "code int, date date, close double"), ["code"]).toPandas().set_index(["code", "date"]).regime
    assert got[(1, day(10))] == "NORMAL" and got[(1, day(299))] == "BULL" and got[(2, day(299))] == "CRISIS"
