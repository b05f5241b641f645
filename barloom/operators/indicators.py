"""Indicators by name and by family, and a registry for more."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from barloom.plans import panel, smoothed

KEYS = ["date", "code"]
#: Families and their indicators, in the order of their columns.
FAMILIES = {
    "trend": ("ind_ma", "ind_ema", "ind_macd", "ind_boll"),
    "oscillator": ("ind_rsi", "ind_kdj", "ind_cci", "ind_willr"),
    "volatility": ("ind_atr", "ind_true_range", "ind_historical_volatility"),
    "volume": ("ind_obv", "ind_vwap", "ind_ad", "ind_mfi"),
}
Indicator = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, Indicator] = {}


def one(name: str, bars: DataFrame) -> DataFrame:
    """date, code and the columns of one indicator."""
    return smoothed.apply(bars, name) if name in smoothed.INDICATORS else panel.run(name, bars=bars)


def _with(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with the columns of an indicator, which replace columns of the same names."""
    return df.drop(*set(found.columns).difference(KEYS)).join(found, KEYS, "left")


def family(name: str, bars: DataFrame) -> DataFrame:
    """bars with the columns of every indicator of a family; one named like a column of bars (vwap) replaces it."""
    return reduce(_with, [one(k, bars) for k in FAMILIES[name]], bars)


def register(name: str, indicator: Indicator) -> None:
    _REGISTRY[name] = indicator


def get(name: str) -> Indicator:
    if name not in _REGISTRY:
        raise KeyError(f"no indicator {name!r}; there are {names()}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def create(name: str, bars: DataFrame) -> DataFrame:
    return get(name)(bars)


for _family in FAMILIES:
    register(_family, lambda bars, k=_family: family(k, bars))
