"""Indicators with recursive means (EMA, MACD, RSI, ATR): one grouped map over each code.

A group is the history of one code, bounded by the calendar. EMA(n) starts at row n
with the mean of the first n known values; Wilder's mean is pandas' ewm of 1/n, known
from the n-th value on. Rows with a null input have a null result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from barloom.sources.bars import weekly_bars

DIGITS = 6


def ema(x: pd.Series, n: int) -> pd.Series:
    known = x.dropna()
    if len(known) < n:
        return pd.Series(np.nan, index=x.index)
    seeded = pd.concat([pd.Series([known.iloc[:n].mean()], index=[known.index[n - 1]]), known.iloc[n:]])
    return seeded.ewm(span=n, adjust=False).mean().reindex(x.index)


def wilder(x: pd.Series, n: int) -> pd.Series:
    known = x.dropna()
    return known.ewm(alpha=1 / n, min_periods=n).mean().reindex(x.index)


def _emas(p: pd.DataFrame) -> dict[str, pd.Series]:
    return {f"ema{n}": ema(p.close, n) for n in (12, 26)}


def _macd(p: pd.DataFrame) -> dict[str, pd.Series]:
    line = ema(p.close, 12) - ema(p.close, 26)
    signal = ema(line, 9)
    return {"macd": line, "signal": signal, "histogram": line - signal}


def _rsi(p: pd.DataFrame) -> dict[str, pd.Series]:
    step = p.close.dropna().diff().reindex(p.index)
    out = {}
    for n in (6, 12, 24):
        up, down = wilder(step.clip(lower=0), n), wilder(-step.clip(upper=0), n)
        out[f"rsi{n}"] = 100 * up / (up + down).replace(0, np.nan)
    return out


def _atr(p: pd.DataFrame) -> dict[str, pd.Series]:
    known = p.dropna(subset=["high", "low", "close"])
    before = known.close.shift()
    true_range = pd.concat([known.high - known.low, (known.high - before).abs(), (known.low - before).abs()], axis=1).max(axis=1).where(before.notna())
    return {"atr": wilder(true_range, 14).reindex(p.index)}


INDICATORS = {"ind_ema": (_emas, ("ema12", "ema26")), "ind_macd": (_macd, ("macd", "signal", "histogram")), "ind_rsi": (_rsi, ("rsi6", "rsi12", "rsi24")), "ind_atr": (_atr, ("atr",))}


def apply(bars: DataFrame, name: str) -> DataFrame:
    """date, code and the columns of one indicator."""
    found, columns = INDICATORS[name]

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date").reset_index(drop=True).astype({c: "float64" for c in ("high", "low", "close")})
        return pd.DataFrame({"date": p.date, "code": p.code} | {k: v.round(DIGITS) for k, v in found(p).items()})

    needed = bars.select("date", "code", "high", "low", "close")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in needed.schema.fields[:2])
    return needed.groupBy("code").applyInPandas(fold, f"{kinds}, {', '.join(f'{c} double' for c in columns)}")


def _query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply(weekly_bars(spark, sf_dir), name)

    return query


def queries() -> dict:
    return {name: _query(name) for name in INDICATORS}
