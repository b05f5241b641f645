"""Performance of equity curves and trades, as DataFrame operators.

Curves: run, date, value (and bench, the benchmark's daily return). A curve has one row
a trading day, so windows by run are bounded by the calendar. Trades: run, code, date,
direction, price, quantity, commission; the k-th buy of a code meets its k-th sale.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR, RISKLESS = 252, 0.03


def _by(*keys: str, order: tuple[str, ...] = ("date",)) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def returns(curve: DataFrame) -> DataFrame:
    """Adds r (null on the first day), peak and drawdown."""
    w = _by("run")
    held = curve.withColumns({"r": F.col("value") / F.nullif(F.lag("value").over(w), F.lit(0.0)) - 1, "peak": F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return held.withColumn("drawdown", (F.col("peak") - F.col("value")) / F.col("peak"))


def rolling_beta(curve: DataFrame, window: int = 60, least: int = 5) -> DataFrame:
    """Adds r and beta: slope of r on bench over the last rows; before `least` pairs, or without variance, that of the whole curve, else 1."""
    held = returns(curve) if "r" not in curve.columns else curve
    w = _by("run").rowsBetween(-(window - 1), 0)
    both = F.col("r").isNotNull() & F.col("bench").isNotNull()
    pair = held.withColumns({"x_": F.when(both, F.col("bench")), "y_": F.when(both, F.col("r"))})
    slope = lambda win: F.covar_samp("y_", "x_").over(win) / F.nullif(F.var_samp("x_").over(win), F.lit(0.0))
    return pair.withColumn("beta", F.coalesce(F.when(F.count("x_").over(w) >= least, slope(w)), slope(Window.partitionBy("run")), F.lit(1.0))).drop("x_", "y_")


def _compound(x: Column, win) -> Column:
    """Running product of 1 + x; a loss of everything ends at 0."""
    gone = F.max(F.when(x <= -1, 1).otherwise(0)).over(win)
    return F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(F.coalesce(F.log1p(F.when(x > -1, x)), F.lit(0.0))).over(win)))


def against_benchmark(curve: DataFrame, window: int = 60) -> DataFrame:
    """run, date, excess (r - bench), alpha (r - beta * bench) and both compounded from 1."""
    held = rolling_beta(curve, window).where("r IS NOT NULL").select("run", "date", (F.col("r") - F.coalesce("bench", F.lit(0.0))).alias("excess"), (F.col("r") - F.col("beta") * F.coalesce("bench", F.lit(0.0))).alias("alpha"))
    w = _by("run").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumns({"cumulative_excess": _compound(F.col("excess"), w), "cumulative_alpha": _compound(F.col("alpha"), w)})


def summary(curve: DataFrame, riskless: float = RISKLESS, confidence: float = 0.95) -> DataFrame:
    """One row a run: total, annual, alpha (annual less that of the benchmark, or less the riskless rate), beta (1 if there is none), volatility, drawdown, duration, var, sharpe, sortino (infinite without a loss), calmar."""
    held = returns(curve)
    below = held.withColumn("island_", F.sum((F.col("value") >= F.col("peak")).cast("int")).over(_by("run").rowsBetween(Window.unboundedPreceding, 0)))
    runs = below.groupBy("run", "island_").agg(F.count_if(F.col("value") < F.col("peak")).alias("n")).groupBy("run").agg(F.max("n").alias("duration"))
    year = math.sqrt(YEAR)
    told = held.groupBy("run").agg(
        (F.max_by("value", "date") / F.min_by("value", "date") - 1).alias("total"), F.count(F.lit(1)).alias("n"), (F.stddev_samp("r") * year).alias("volatility"), (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * year).alias("down"),
        F.count_if(F.col("r") < 0).alias("losses"), F.max("drawdown").alias("drawdown"), F.expr(f"percentile(r, {1 - confidence!r})").alias("var"), F.exp(F.sum(F.log1p("bench"))).alias("bench_total"), F.count("bench").alias("n_bench"),
        (F.covar_samp(F.when(F.col("bench").isNotNull(), F.col("r")), F.when(F.col("r").isNotNull(), F.col("bench"))) / F.nullif(F.var_samp(F.when(F.col("r").isNotNull(), F.col("bench"))), F.lit(0.0))).alias("beta"))
    annual = told.withColumn("annual", F.pow(1 + F.col("total"), F.lit(float(YEAR)) / F.col("n")) - 1)
    market = F.when(F.col("n_bench") > 0, F.pow(F.col("bench_total"), F.lit(float(YEAR)) / F.col("n_bench")) - 1).otherwise(riskless)
    over = F.col("annual") - riskless
    return annual.join(runs, "run").select(
        "run", "total", "annual", (F.col("annual") - market).alias("alpha"), F.coalesce("beta", F.lit(1.0)).alias("beta"), "volatility", "drawdown", "duration", "var",
        F.coalesce(over / F.nullif("volatility", F.lit(0.0)), F.lit(0.0)).alias("sharpe"), F.when(F.col("losses") == 0, F.lit(float("inf"))).otherwise(F.coalesce(over / F.nullif("down", F.lit(0.0)), F.lit(0.0))).alias("sortino"),
        F.coalesce(F.col("annual") / F.nullif("drawdown", F.lit(0.0)), F.lit(0.0)).alias("calmar"))


def report(told: DataFrame) -> DataFrame:
    """summary() as text: shares in percent, ratios with three digits."""
    percent = [F.format_string("%.2f%%", 100 * F.col(c)).alias(c) for c in ("total", "annual", "alpha", "volatility", "drawdown", "var")]
    return told.select("run", *percent, *[F.format_string("%.3f", c).alias(c) for c in ("beta", "sharpe", "sortino", "calmar")], F.col("duration").cast("string").alias("duration"))


def pair_trades(trades: DataFrame) -> DataFrame:
    """run, code, k, buy_date, sell_date, buy_value, sell_value, pnl (less both commissions), pnl_pct, holding_days."""
    order = Window.partitionBy("run", "code", "direction").orderBy("date", *(["seq"] if "seq" in trades.columns else []), "price")
    placed = trades.withColumn("k", F.row_number().over(order))
    side = lambda name, p: placed.where(F.col("direction") == name).select("run", "code", "k", F.col("date").alias(f"{p}_date"), (F.col("price") * F.col("quantity")).alias(f"{p}_value"), F.col("commission").alias(f"{p}_fee"))
    both = side("buy", "buy").join(side("sell", "sell"), ["run", "code", "k"])
    pnl = F.col("sell_value") - F.col("buy_value") - F.col("buy_fee") - F.col("sell_fee")
    return both.withColumn("pnl", pnl).select("run", "code", "k", "buy_date", "sell_date", "buy_value", "sell_value", "pnl", (F.col("pnl") / F.nullif("buy_value", F.lit(0.0))).alias("pnl_pct"), F.datediff("sell_date", "buy_date").alias("holding_days"))


def trade_alpha(paired: DataFrame, curve: DataFrame) -> DataFrame:
    """paired with alpha_pnl = pnl - beta * buy_value * return of the benchmark from buy to sale, and its share; beta is the mean of the run's.

    The benchmark's level is joined by equality at both ends (as of the date), not by a range of days.
    """
    w = _by("run").rowsBetween(Window.unboundedPreceding, 0)
    level = rolling_beta(curve).withColumn("nav", _compound(F.coalesce("bench", F.lit(0.0)), w)).select("run", "date", "nav", "beta")
    mean = level.groupBy("run").agg(F.avg("beta").alias("beta_"))

    def at(df: DataFrame, day: str, name: str, first: bool) -> DataFrame:
        """The level on the first curve day from the date on, or the last up to it."""
        marks = df.select("run", F.col(day).alias("date")).distinct()
        both = marks.join(level.select("run", "date", "nav"), ["run", "date"], "full")
        win = _by("run").rowsBetween(0, Window.unboundedFollowing) if first else w
        held = both.withColumn(name, (F.first if first else F.last)("nav", ignorenulls=True).over(win)).select("run", F.col("date").alias(day), name)
        return df.join(held, ["run", day], "left")

    told = at(at(paired, "buy_date", "nav_buy_", True), "sell_date", "nav_sell_", False).join(mean, "run", "left")
    move = F.coalesce(F.when(F.col("nav_sell_").isNotNull() & F.col("nav_buy_").isNotNull(), F.col("nav_sell_") / F.nullif("nav_buy_", F.lit(0.0)) - 1), F.lit(0.0))
    alpha = F.col("pnl") - F.coalesce("beta_", F.lit(1.0)) * F.col("buy_value") * move
    return told.withColumn("alpha_pnl", alpha).withColumn("alpha_pnl_pct", F.coalesce(F.col("alpha_pnl") / F.nullif("buy_value", F.lit(0.0)), F.lit(0.0))).select(*paired.columns, "alpha_pnl", "alpha_pnl_pct")


def trade_statistics(paired: DataFrame) -> DataFrame:
    """One row a run: counts, win rate, mean and sum of gains and losses, payoff, profit factor (infinite without losses), longest runs of gains and losses (a flat trade ends both), mean holding days."""
    order = _by("run", order=("sell_date", "code", "k"))
    signed = paired.withColumn("s_", F.signum("pnl").cast("int"))
    turned = signed.withColumn("new_", (F.coalesce(F.lag("s_").over(order), F.lit(9)) != F.col("s_")).cast("int")).withColumn("g_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streaks = turned.groupBy("run", "g_", "s_").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(*[F.coalesce(F.max(F.when(F.col("s_") == s, F.col("n"))), F.lit(0)).alias(c) for s, c in ((1, "win_streak"), (-1, "loss_streak"))])
    won, lost = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    told = paired.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count(won).alias("n_wins"), F.count(lost).alias("n_losses"), F.coalesce(F.avg(won), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(lost), F.lit(0.0)).alias("mean_loss"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("sum_win"), F.coalesce(-F.sum(lost), F.lit(0.0)).alias("sum_loss"), *[F.coalesce(F.avg(F.when(x.isNotNull(), F.col("holding_days"))), F.lit(0.0)).alias(c) for x, c in ((won, "win_days"), (lost, "loss_days"))])
    ratio = lambda a, b: F.when(b == 0, F.lit(float("inf"))).otherwise(a / F.when(b != 0, b))
    return told.join(streaks, "run").withColumns({"win_rate": F.col("n_wins") / F.col("n_trades"), "payoff": ratio(F.col("mean_win"), -F.col("mean_loss")), "profit_factor": ratio(F.col("sum_win"), F.col("sum_loss"))}).drop("sum_win", "sum_loss")


def trade_summary(trades: DataFrame) -> DataFrame:
    """code, direction, n, quantity, mean price, commission, rounded to cents."""
    return trades.groupBy("code", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.round(F.avg("price"), 2).alias("mean_price"), F.round(F.sum("commission"), 2).alias("commission"))


def monthly_returns(curve: DataFrame) -> DataFrame:
    """run, year and one column a month: the heat map of compounded returns."""
    held = returns(curve).where("r IS NOT NULL").groupBy("run", F.year("date").alias("year"), F.month("date").alias("month")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("x"))
    return held.groupBy("run", "year").pivot("month", list(range(1, 13))).agg(F.first("x"))
