"""Strategies: classes run inside the fold. A strategy sees rows up to the current date only."""

from __future__ import annotations

from itertools import compress

import numpy as np

from barloom.backtest.broker import LOT, Account, Order
from barloom.backtest.risk import RiskMonitor, StopLoss, buy_amount


class Strategy:
    """Base class: hooks of the fold and the order helpers."""

    def __init__(self, **params):
        self.params, self.orders = dict(params), []
        self.account: Account | None = None

    def set_params(self, **params) -> None:
        self.params.update(params)

    def get_param(self, key: str, default=None):
        return self.params.get(key, default)

    def rows(self) -> int | None:
        """Rows of the past that the strategy asks for, today's included; None: all."""
        return None

    def initialize(self) -> None: ...

    def before_trading(self) -> None: ...

    def handle_bar(self, bar: Bar) -> None:
        raise NotImplementedError

    def after_trading(self) -> None: ...

    def on_order(self, order: Order) -> None: ...

    def on_trade(self, order: Order) -> None: ...

    def _queue(self, order: Order) -> Order:
        self.orders.append(order)
        self.on_order(order)
        return order

    def buy(self, code: str, quantity: int, price: float | None = None, reason: str = "") -> Order:
        return self._queue(Order(code, True, int(quantity), price, reason))

    def sell(self, code: str, quantity: int, price: float | None = None, reason: str = "") -> Order:
        return self._queue(Order(code, False, int(quantity), price, reason))

    def order_target_percent(self, code: str, share: float, price: float | None = None, reason: str = "") -> Order | None:
        """Buy or sell whole lots towards a share of the portfolio; differences under 100 are left."""
        at = price or self.account.price(code)
        gap = share * self.account.value - self.account.position(code).value
        lots = int(abs(gap) // at // LOT * LOT) if at > 0 else 0
        if abs(gap) < 100 or lots <= 0:
            return None
        return (self.buy if gap > 0 else self.sell)(code, lots, price, reason)

    def pending(self) -> list[Order]:
        return [o for o in self.orders if o.status == "pending"]

    def cancel_all(self) -> None:
        for o in self.pending():
            o.status = "cancelled"


class Bar:
    """One date: closes of the codes that trade, and for each column a (dates, codes) history up to it."""

    def __init__(self, date, codes: list[str], panels: dict[str, np.ndarray], row: int, known: dict[str, np.ndarray] | None = None, whole: bool = True):
        self.date, self.codes, self._panels, self._row, self._known, self._whole = date, codes, panels, row, known, whole
        today = panels["close"][row]
        trades = ~np.isnan(today)
        self.closes = dict(zip(compress(codes, trades), today[trades].tolist()))

    def history(self, column: str, n: int | None = None) -> np.ndarray:
        if not self._whole and (n is None or n > self._row + 1):
            raise ValueError("these rows of the past are not kept; the strategy's rows() has to ask for them")
        return self._panels[column][max(0, self._row + 1 - n) if n else 0 : self._row + 1]

    def latest(self, column: str) -> np.ndarray | None:
        """The last row of a column that has a value, today's included."""
        if self._known is not None:
            return self._known.get(column)
        return latest_of(self._panels[column][: self._row + 1])


def latest_of(rows: np.ndarray) -> np.ndarray | None:
    return next((row for row in rows[::-1] if not np.isnan(row).all()), None)


class DualAverage(Strategy):
    """Buys where the short mean of closes crosses above the long one, sells where it crosses below or a stop holds.

    With `literal` the run halts on any alert level, green included, and so never trades.
    """

    def rows(self) -> int:
        return self.get_param("long", 20) + 1

    def initialize(self) -> None:
        self.risk, self.stops = RiskMonitor(), StopLoss(stop=self.get_param("stop", 0.08), take=self.get_param("take", 0.20))

    def handle_bar(self, bar: Bar) -> None:
        self.risk.update(self.account.value)
        if self.risk.frozen or self.get_param("literal", False):
            return
        short, long = self.get_param("short", 5), self.get_param("long", 20)
        for code in list(self.account.positions):
            p, price = self.account.position(code), bar.closes.get(code)
            if price and (why := self.stops.check(p, price)):
                self.sell(code, p.quantity, reason=why)
                self.stops.reset(code)
        closes = bar.history("close", long + 1)
        if len(closes) < long + 1:
            return
        now, before = closes[-short:].mean(axis=0) - closes[-long:].mean(axis=0), closes[-short - 1 : -1].mean(axis=0) - closes[-long - 1 : -1].mean(axis=0)
        for k in np.flatnonzero(((now > 0) & (before <= 0)) | ((now < 0) & (before >= 0))):
            code = bar.codes[k]
            held = self.account.position(code).quantity
            if now[k] > 0 >= before[k] and not held:
                self.buy(code, int(buy_amount(self.account, code, self.get_param("share", 0.1) * self.account.value) // bar.closes[code] // LOT * LOT) if code in bar.closes else 0, reason="cross_up")
            elif now[k] < 0 <= before[k] and held:
                self.sell(code, held, reason="cross_down")


class TopFactor(Strategy):
    """Every `every` dates holds the `top` codes of the column `factor` in equal parts; others go, heavy ones (over 1.1 times) too."""

    def rows(self) -> int:
        return 1

    def initialize(self) -> None:
        self.risk, self.stops, self.day = RiskMonitor(), StopLoss(stop=self.get_param("stop", 0.08), take=self.get_param("take", 0.20)), 0

    def portfolio(self, factor: np.ndarray, codes: list[str]) -> dict[str, float]:
        known = np.flatnonzero(~np.isnan(factor))  # codes are sorted, so ties go by code
        order = known[np.argsort(-factor[known] if self.get_param("largest", True) else factor[known], kind="stable")][: self.get_param("top", 10)]
        return {codes[k]: 1 / len(order) for k in order}

    def handle_bar(self, bar: Bar) -> None:
        self.risk.update(self.account.value)
        sold = set()
        for code in list(self.account.positions):
            p, price = self.account.position(code), bar.closes.get(code)
            if price and (why := self.stops.check(p, price)):
                self.sell(code, p.quantity, reason=why)
                self.stops.reset(code)
                sold.add(code)
        self.day += 1
        if (self.day - 1) % self.get_param("every", 5) or self.risk.frozen:
            return
        factor = bar.latest("factor")
        if factor is None:
            return
        wanted = {c: w for c, w in self.portfolio(factor, bar.codes).items() if c not in sold}
        for code in list(self.account.positions):
            p = self.account.position(code)
            if code not in sold and (code not in wanted or p.value > 1.1 * wanted[code] * self.risk.scale * self.account.value):
                self.sell(code, p.quantity, reason="rebalance")
        for code, w in wanted.items():
            gap = w * self.risk.scale * self.account.value - self.account.position(code).value
            if gap > 0 and code in bar.closes:
                self.buy(code, int(buy_amount(self.account, code, gap) // bar.closes[code] // LOT * LOT), reason="rebalance")


REGISTRY: dict[str, type[Strategy]] = {"dual_average": DualAverage, "top_factor": TopFactor}


def register(name: str, strategy: type[Strategy]) -> None:
    REGISTRY[name] = strategy


def create(name: str, **params) -> Strategy:
    if name not in REGISTRY:
        raise KeyError(f"no strategy {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**params)
