"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.algebra import parse, windows
from barloom.plans import factors101, factors191, panel, smoothed, studies
from barloom.plans.planner import KEYS, compute, duck_sql, shown
from barloom.sources.bars import DUCK_BARS, weekly_bars

Query = Callable[[SparkSession, str], DataFrame]
#: One query for each operator of the algebra.
OPERATORS = {
    "rank": "RANK(C)", "scale": "SCALE(C-O)", "ind_neutralize": "INDNEUT(C)", "delay": "DELAY(C,3)", "delta": "DELTA(C,3)", "ts_min": "TSMIN(L,6)", "ts_max": "TSMAX(H,6)",
    "ts_argmin": "ARGMIN(L,6)", "ts_argmax": "ARGMAX(H,6)", "ts_rank": "TSRANK(C,8)", "ts_sum": "SUM(V,5)", "ts_product": "PROD(C/O,4)", "ts_stddev": "STD(C,8)", "sma": "MEAN(C,8)",
    "ts_corr": "CORR(C,V,12)", "ts_cov": "COV(C,V,12)", "decay_linear": "DECAY(C,5)", "sign": "SIGN(C-O)", "signedpower": "SPOW(C-O,2)", "log": "LOG(V)", "adv": "ADV(10)",
    "ema_sma": "EMA(C,7,2)", "wma": "WMA(C,6)", "slope": "SLOPE(C,6)", "count": "COUNT(C>O,10)", "sumif": "SUMIF(V,10,C>O)", "highday": "HIGHDAY(H,8)", "lowday": "LOWDAY(L,8)", "filter_cond": "IF(C>O,C,0/0)", "sumac": "CUMSUM(V)", "regbeta": "REGBETA(C,V,8)", "cumprod": "CUMPROD(IF(C>O,O/C,1))",
}
FORMULAS = {f"op_{k}": v for k, v in OPERATORS.items()} | {f"alpha101_{k:03d}": v for k, v in factors101.FORMULAS.items()} | {f"alpha191_{k:03d}": v for k, v in factors191.FORMULAS.items()}


#: Values beyond 1e15, of which the engines' pow() gives other last digits: no SQL.
NOISY = {"alpha101_084", "alpha191_143"}


def _factor(formula: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compute(weekly_bars(spark, sf_dir), {"value": formula}).select(*KEYS, F.expr(shown("value")).alias("value"))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha 3 of the 101 on the weekly bars."""
    return _factor(factors101.FORMULAS[3])(spark, sf_dir)


def all_factors(formulas: dict[int, str]) -> Query:
    """All factors of a set in one staged plan, in long form: factor, date, code, value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = compute(weekly_bars(spark, sf_dir), {f"alpha{k:03d}": f for k, f in formulas.items()})
        return wide.unpivot(KEYS, [c for c in wide.columns if c not in KEYS], "factor", "value").withColumn("value", F.expr(shown("value")))

    return run


#: Factors computed together in one plan by the queries alpha101_together and alpha191_together.
TOGETHER = {"alpha101_together": {k: factors101.FORMULAS[k] for k in (3, 6, 12, 33, 41, 101)}, "alpha191_together": {k: factors191.FORMULAS[k] for k in (2, 6, 14, 18, 20, 30)}}


def _together_sql(formulas: dict[int, str]) -> str:
    named = {f"alpha{k:03d}": f for k, f in formulas.items()}
    return f"SELECT * FROM ({duck_sql(DUCK_BARS, named, True)}) UNPIVOT INCLUDE NULLS (value FOR factor IN ({', '.join(named)}))"


def queries() -> dict[str, Query]:
    return {"bars_weekly": weekly_bars} | {k: all_factors(f) for k, f in TOGETHER.items()} | {k: _factor(f) for k, f in FORMULAS.items()} | panel.queries() | smoothed.queries() | studies.queries()


def recursive(formula: str) -> bool:
    return any(n[0] == "EMA" for n in windows(parse(formula)))


def oracle_sql() -> dict[str, str]:
    return {"bars_weekly": DUCK_BARS} | {k: _together_sql(f) for k, f in TOGETHER.items()} | {k: duck_sql(DUCK_BARS, {"value": f}, True) for k, f in FORMULAS.items() if k not in NOISY and not recursive(f)} | panel.oracle_sql() | studies.oracle_sql()
