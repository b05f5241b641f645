"""The fold over dates, and its distribution: runs dealt over tasks that read the dates in order.

A run is sequential by nature. Runs (parameter sets) are rows of a frame, dealt over tasks;
a grid is as parallel as it has rows. The panel of a universe (dates x codes) is packed into
one row a date, and each task gets all of them, sorted, as a stream. It holds as many past
rows as its strategies ask for, so neither the driver nor a task holds the whole panel,
unless a strategy asks for the whole past.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.backtest.broker import Account, Broker, Costs, Events
from barloom.backtest.strategies import Bar, Strategy, create

EQUITY = "run string, date date, value double, cash double, daily_return double"
TRADES = "run string, seq int, date date, code string, direction string, price double, quantity long, amount double, commission double, reason string"


class Fold:
    """One run, moved on by a bar at a time."""

    def __init__(self, strategy: Strategy, cash: float, costs: Costs | None = None):
        self.account, self.strategy = Account(cash), strategy
        self.broker, self.events = Broker(self.account, costs), Events()
        strategy.account = self.account
        self.events.register("fill", strategy.on_trade)
        strategy.initialize()

    def step(self, bar: Bar) -> None:
        account, strategy = self.account, self.strategy
        account.date = bar.date
        self.broker.new_day()
        strategy.before_trading()
        account.mark(bar.closes)
        strategy.handle_bar(bar)
        for order in strategy.pending():
            if self.broker.process(order):
                self.events.emit("fill", order)
        strategy.orders = []
        account.record()
        strategy.after_trading()


def fold(strategy: Strategy, dates: list, codes: list[str], panels: dict[str, np.ndarray], cash: float, costs: Costs | None = None, start=None, end=None) -> tuple[list[tuple], list[tuple]]:
    """Equity rows and trades of one run. Dates before `start` are history that the strategy may read."""
    run = Fold(strategy, cash, costs)
    for row, date in enumerate(dates):
        if (start is None or date >= start) and (end is None or date <= end):
            run.step(Bar(date, codes, panels, row))
    return run.account.equity, run.broker.trades


class Past:
    """The last `keep` rows (None: all) of each column, over the codes seen so far, in order."""

    def __init__(self, columns: list[str], keep: int | None):
        self.columns, self.keep, self.n, self.whole = columns, keep, 0, True
        self.names, self.codes = pa.array([], pa.string()), []
        self.held: dict[str, np.ndarray] = {c: np.empty((0, 0)) for c in columns}
        self.known: dict[str, np.ndarray] = {}

    def _widen(self, names: pa.Array) -> None:
        """More codes: they have no values in the rows before."""
        if pc.count_distinct(names).as_py() < len(names):
            raise ValueError("a code has two rows on one date")
        union = pa.array(sorted({*self.codes, *names.to_pylist()}), pa.string())
        at = pc.index_in(self.names, value_set=union).to_numpy(zero_copy_only=False).astype(int)

        def moved(x: np.ndarray) -> np.ndarray:
            out = np.full((*x.shape[:-1], len(union)), np.nan)
            out[..., at] = x
            return out

        self.held = {c: moved(x) for c, x in self.held.items()}
        self.known = {c: moved(x) for c, x in self.known.items()}
        self.names, self.codes = union, union.to_pylist()

    def push(self, date, names: pa.Array, values: dict[str, np.ndarray]) -> Bar:
        """names are sorted."""
        if not names.equals(self.names):
            at = pc.index_in(names, value_set=self.names)
            if at.null_count or pc.count_distinct(names).as_py() < len(names):
                self._widen(names)
                at = pc.index_in(names, value_set=self.names)
            at, given = at.to_numpy(zero_copy_only=False).astype(int), values
            values = {c: np.full(len(self.codes), np.nan) for c in self.columns}
            for c, x in given.items():
                values[c][at] = x
        if self.n == len(self.held[self.columns[0]]):
            self._room()
        for c, x in values.items():
            self.held[c][self.n] = x
            if not np.isnan(x).all():
                self.known[c] = x
        self.n += 1
        return Bar(date, self.codes, self.held, self.n - 1, self.known, self.whole)

    def _room(self) -> None:
        """Twice the rows that stay; rows before them are dropped."""
        stay = self.n if self.keep is None else min(self.n, max(1, self.keep) - 1)
        self.whole = self.whole and stay == self.n
        for c, x in self.held.items():
            grown = np.empty((2 * max(stay, 8), len(self.codes)))
            grown[:stay] = x[self.n - stay : self.n]
            self.held[c] = grown
        self.n = stay


def packed(bars: DataFrame, columns: list[str]) -> DataFrame:
    """One row a date: codes in order, as JSON, and an array of each column (v0, v1, ...). Rows without a date or a code belong to no bar.

    The codes are as a rule those of the date before; as one text they are a third of the size and are read only when they change.
    """
    values = [f"v{k}" for k in range(len(columns))]
    cell = F.struct(F.col("code").cast("string").alias("code"), *[F.col(c).cast("double").alias(v) for c, v in zip(columns, values)])
    days = bars.where("date IS NOT NULL AND code IS NOT NULL").groupBy(F.col("date").cast("date").alias("date")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return days.select("date", F.to_json("cells.code").alias("code"), *[F.col(f"cells.{v}").alias(v) for v in values])


def _frame(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def run_all(bars: DataFrame, runs: DataFrame, columns: list[str] | None = None, cash: float = 1e6, trades: bool = False) -> DataFrame:
    """The equity of every run (or its trades). runs: run string, strategy string, params string (JSON)."""
    columns, spark = columns or ["close"], bars.sparkSession
    n = max(1, min(runs.count(), spark.sparkContext.defaultParallelism))
    place = (F.row_number().over(Window.orderBy("run", "strategy", "params")) - 1) % n
    dealt = runs.select(place.cast("int").alias("task"), F.struct("run", "strategy", "params").alias("run")).groupBy("task").agg(F.sort_array(F.collect_list("run")).alias("runs"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        text, names = None, pa.array([], pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                day = [batch.column(j)[k] for j in range(1, batch.num_columns)]
                if (given := day[2].as_py()) != text:
                    text, names = given, pa.array(json.loads(given), pa.string())
                yield day[0], day[1].as_py(), names, {c: v.values.to_numpy(zero_copy_only=False).astype(float) for c, v in zip(columns, day[3:])}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, past = None, None
        for given, date, names, values in rows_of(batches):
            if folds is None:
                folds = [(r["run"], Fold(create(r["strategy"], **json.loads(r["params"] or "{}")), cash)) for r in given.as_py()]
                asked = [f.strategy.rows() for _, f in folds]
                past = Past(columns, None if None in asked else max(asked))
            bar, out = past.push(date, names, values), []
            for run, f in folds:
                before = len(f.broker.trades)
                f.step(bar)
                out += [(run, k, *t) for k, t in enumerate(f.broker.trades[before:], before)] if trades else [(run, *f.account.equity[-1])]
            if out:
                yield _frame(out, TRADES if trades else EQUITY)

    days = packed(bars, columns).crossJoin(F.broadcast(dealt)).select("task", "runs", "date", "code", *[f"v{k}" for k in range(len(columns))])
    return days.repartitionById(n, "task").sortWithinPartitions("date").mapInArrow(each, TRADES if trades else EQUITY)


def grid(spark: SparkSession, strategy: str, **values: list) -> DataFrame:
    """All combinations of parameter values in which short < long where both are given."""
    rows: list[dict] = [{}]
    for key, some in values.items():
        rows = [r | {key: v} for r in rows for v in some]
    rows = [r for r in rows if not ("short" in r and "long" in r) or r["short"] < r["long"]]
    return spark.createDataFrame([(",".join(f"{k}={v}" for k, v in r.items()), strategy, json.dumps(r)) for r in rows], "run string, strategy string, params string")


def summary(equity: DataFrame, days: int = 252, riskless: float = 0.03) -> DataFrame:
    """run, days, total, annual, volatility, drawdown, sharpe of every run, sorted by sharpe."""
    back = Window.partitionBy("run").orderBy("date")
    held = equity.withColumn("peak", F.max("value").over(back)).withColumn("step", F.col("value") / F.lag("value").over(back) - 1)
    told = held.groupBy("run").agg(F.count("*").alias("days"), (F.max_by("value", "date") / F.min_by("value", "date") - 1).alias("total"), (F.stddev_samp("step") * math.sqrt(days)).alias("volatility"), F.max((F.col("peak") - F.col("value")) / F.col("peak")).alias("drawdown"))
    annual = F.pow(1 + F.col("total"), F.lit(float(days)) / F.col("days")) - 1
    return told.withColumn("annual", annual).withColumn("sharpe", F.coalesce((F.col("annual") - riskless) / F.nullif("volatility", F.lit(0.0)), F.lit(0.0))).orderBy(F.desc("sharpe"), "run")
