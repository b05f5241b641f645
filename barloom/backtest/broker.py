"""State of one run: orders, positions, cash, and the broker that matches them.

Fills are at the day's close with slippage, in lots; what is bought today can be
sold from the next trading day on. Shares that make no whole lot cannot be sold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

LOT = 100


@dataclass
class Costs:
    commission: float = 0.00025
    least_commission: float = 5.0
    stamp_duty: float = 0.001
    slippage: float = 0.002


@dataclass
class Order:
    code: str
    buys: bool
    quantity: int
    limit: float | None = None
    reason: str = ""
    status: str = "pending"
    price: float = 0.0
    commission: float = 0.0


@dataclass
class Position:
    code: str
    quantity: int = 0
    frozen: int = 0
    cost: float = 0.0
    price: float = 0.0

    @property
    def value(self) -> float:
        return self.quantity * self.price

    @property
    def gain(self) -> float:
        return self.price / self.cost - 1 if self.cost > 0 else 0.0


@dataclass
class Account:
    """What a strategy sees: cash, positions, last known prices, equity so far."""

    cash: float
    start: float = 0.0
    positions: dict[str, Position] = field(default_factory=dict)
    prices: dict[str, float] = field(default_factory=dict)
    equity: list[tuple] = field(default_factory=list)
    date: object = None
    value: float = 0.0

    def __post_init__(self) -> None:
        self.start = self.value = self.cash

    def position(self, code: str) -> Position:
        return self.positions.get(code, Position(code))

    def price(self, code: str) -> float:
        return self.prices.get(code, 0.0)

    def mark(self, prices: dict[str, float]) -> None:
        """New prices; a code without one keeps its last."""
        self.prices.update(prices)
        for code, p in self.positions.items():
            p.price = self.prices.get(code, p.price)
        self.value = self.cash + sum(p.value for p in self.positions.values())

    def record(self) -> None:
        self.mark({})
        before = self.equity[-1][1] if self.equity else self.value
        self.equity.append((self.date, self.value, self.cash, self.value / before - 1 if before else 0.0))


class Broker:
    def __init__(self, account: Account, costs: Costs | None = None):
        self.account, self.costs, self.trades = account, costs or Costs(), []

    def new_day(self) -> None:
        for p in self.account.positions.values():
            p.frozen = 0

    def fill_price(self, order: Order) -> float:
        """The limit price, or else the close, moved against the order."""
        base = order.limit if order.limit else self.account.price(order.code)
        return base * (1 + self.costs.slippage if order.buys else 1 - self.costs.slippage)

    def process(self, order: Order) -> bool:
        price, lots = self.fill_price(order), order.quantity // LOT * LOT
        order.status = "rejected"
        if price > 0 and lots > 0 and (self._buy if order.buys else self._sell)(order, price, lots):
            order.status, order.price = "filled", price
            self.trades.append((self.account.date, order.code, "buy" if order.buys else "sell", price, order.quantity, price * order.quantity, order.commission, order.reason))
        return order.status == "filled"

    def _fee(self, amount: float) -> float:
        return max(amount * self.costs.commission, self.costs.least_commission)

    def _affordable(self, price: float, most: int, cash: float) -> int:
        """The largest number of lots, at most `most`, that cash pays for. Beyond 2^53 shares one lot less may cost the same, so lots are not counted down one by one."""
        pays = lambda k: price * (k * LOT) + self._fee(price * (k * LOT)) <= cash
        low, step = most, 1
        while low > 0 and not pays(low):
            most, low, step = low - 1, low - step, step * 2
        low = max(0, low)
        while low < most:
            mid = (low + most + 1) // 2
            low, most = (mid, most) if pays(mid) else (low, mid - 1)
        return low

    def _buy(self, order: Order, price: float, lots: int) -> bool:
        cash = self.account.cash
        if price * lots + self._fee(price * lots) > cash:  # as many lots as cash pays for, fee included
            lots = self._affordable(price, int(cash / (price * (1 + self.costs.commission))) // LOT, cash) * LOT
        if lots <= 0:
            return False
        fee = self._fee(price * lots)
        p = self.account.positions.setdefault(order.code, Position(order.code))
        p.cost = (p.cost * p.quantity + price * lots) / (p.quantity + lots)
        p.quantity, p.frozen, p.price = p.quantity + lots, p.frozen + lots, self.account.price(order.code) or price
        self.account.cash -= price * lots + fee
        order.quantity, order.commission = lots, fee
        return True

    def _sell(self, order: Order, price: float, lots: int) -> bool:
        p = self.account.position(order.code)
        lots = min(lots, (p.quantity - p.frozen) // LOT * LOT)
        if lots <= 0:
            return False
        fee = self._fee(price * lots) + price * lots * self.costs.stamp_duty
        p.quantity -= lots
        self.account.cash += price * lots - fee
        order.quantity, order.commission = lots, fee
        if not p.quantity:
            del self.account.positions[order.code]
        return True


class Events:
    """Handlers by kind (market, order, fill, risk, timer), called in the order of registration."""

    KINDS = ("market", "order", "fill", "risk", "timer")

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable]] = defaultdict(list)

    def register(self, kind: str, handler: Callable) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"unknown event {kind!r}")
        self.handlers[kind].append(handler)

    def emit(self, kind: str, payload: object = None) -> None:
        for handler in self.handlers[kind]:
            handler(payload)
