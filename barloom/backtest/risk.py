"""Risk rules of one run, and the same rules as expressions over whole frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.backtest.broker import Account, Position

#: Drawdown from which a level holds, and the share of the portfolio it allows.
LEVELS = ((0.10, "RED", 0.3), (0.07, "ORANGE", 0.6), (0.04, "YELLOW", 0.8), (0.0, "GREEN", 1.0))
#: Share of the portfolio in each market regime.
REGIME_SCALES = {"BULL": 1.0, "NORMAL": 0.8, "BEAR": 0.5, "CRISIS": 0.2}


@dataclass
class RiskMonitor:
    peak: float = 0.0
    drawdown: float = 0.0
    level: str = "GREEN"
    scale: float = 1.0

    def update(self, value: float) -> str:
        self.peak = max(self.peak, value)
        self.drawdown = (self.peak - value) / self.peak if self.peak > 0 else 0.0
        _, self.level, self.scale = next(x for x in LEVELS if self.drawdown >= x[0])
        return self.level

    @property
    def frozen(self) -> bool:
        return self.level == "RED"

    def reset(self) -> None:
        self.peak, self.drawdown, self.level, self.scale = 0.0, 0.0, "GREEN", 1.0


@dataclass
class StopLoss:
    """kind: fixed (loss from cost), trailing (fall from the high) or atr (fall of `times` ranges)."""

    kind: str = "fixed"
    stop: float = 0.08
    trailing: float = 0.10
    take: float | None = 0.20
    times: float = 2.0
    highs: dict[str, float] = field(default_factory=dict)

    def check(self, position: Position, price: float, atr: float | None = None) -> str:
        """'' or the reason to sell; the stop is asked first, then the high moves up."""
        if position.quantity <= 0 or position.cost <= 0:
            return ""
        high, gain = max(self.highs.get(position.code, position.cost), position.cost), price / position.cost - 1
        if self.kind == "fixed":
            stopped = gain <= -self.stop
        elif self.kind == "trailing":
            stopped = price <= high * (1 - self.trailing)
        else:
            stopped = atr is not None and price <= position.cost - self.times * atr
        if stopped:
            return "stop_loss"
        if self.take is not None and gain >= self.take:
            return "take_profit"
        self.highs[position.code] = max(high, price)
        return ""

    def reset(self, code: str) -> None:
        self.highs.pop(code, None)


def buy_amount(account: Account, code: str, amount: float, single: float = 0.25, total: float = 0.95) -> float:
    """What may be spent on a code: the caps on one code and on all, and the cash."""
    held = sum(p.value for p in account.positions.values())
    room = min(single * account.value - account.position(code).value, total * account.value - held, account.cash)
    return max(0.0, min(amount, room))


def regime(prices: Column | str, by: list[str], order: str = "date") -> Column:
    """The market regime at each row: trend of 20 against 60 rows, volatility of 20 against 252, and the return of four rows; under 252 rows NORMAL."""
    price = F.col(prices) if isinstance(prices, str) else prices
    ahead = Window.partitionBy(*by).orderBy(order)
    rows = lambda n: ahead.rowsBetween(-(n - 1), 0)
    mean = lambda n: F.avg(price).over(rows(n))
    step = price / F.lag(price).over(ahead) - 1
    return F.struct(F.count(price).over(rows(252)).alias("n"), (mean(20) > mean(60)).alias("up"), step.alias("step"), (price / F.lag(price, 4).over(ahead) - 1).alias("recent"))


def regimes(prices: DataFrame, by: list[str] | None = None, price: str = "close", order: str = "date", jump: float = 1.5, crash: float = -0.05) -> DataFrame:
    """prices with regime and scale. Order of the rules: CRISIS (volatility has jumped and the last rows fell), BEAR, BULL, NORMAL."""
    by = by or []
    ahead = Window.partitionBy(*by).orderBy(order)
    rows = lambda n: ahead.rowsBetween(-(n - 1), 0)
    held = prices.withColumn("r_", regime(price, by, order))
    vol = lambda n: F.stddev_samp("r_.step").over(rows(n))
    judged = held.withColumn("v_", vol(20) / F.nullif(vol(252), F.lit(0.0)))
    stressed = F.coalesce(F.col("v_") > jump, F.lit(False))
    name = F.when(F.col("r_.n") < 252, "NORMAL").when(stressed & (F.col("r_.recent") < crash), "CRISIS").when(~F.col("r_.up") & stressed, "BEAR").when(~F.col("r_.up"), "BEAR").when(~stressed, "BULL").otherwise("NORMAL")
    scales = F.create_map(*[F.lit(x) for kv in REGIME_SCALES.items() for x in kv])
    return judged.withColumn("regime", name).withColumn("scale", scales[F.col("regime")]).drop("r_", "v_")


def stock_filter(listed: DataFrame, on: Column, blacklist: list[str] | None = None, least_days: int = 60) -> DataFrame:
    """Rows (code, name, list_date) without special treatment in the name, listed for `least_days` at `on`, not on the blacklist."""
    kept = listed.where(~F.upper("name").contains("ST") & (F.datediff(on, F.col("list_date")) >= least_days))
    return kept.where(~F.col("code").isin(blacklist)) if blacklist else kept
