"""Indicators, cleaning, factor evaluation, performance, risk and storage rules over the bars.

Each operator is one SQL text over named inputs ({bars}, {supplier}, {orders}), read by
Spark and, with the few differing functions exchanged, by DuckDB. `run` applies one to
any frames with the same columns. All windows are by code, by date or over the calendar
(one row a week), so no window grows with the number of codes but those of a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.bars import DUCK_BARS, weekly_bars

_STEP = "(PARTITION BY code ORDER BY date)"
_SINCE = "(PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
#: What the engines call differently: (Spark, DuckDB).
_NAMES = {"@pct(": ("percentile(", "quantile_cont("), "@known(": ("last_value(", "last_value("), "@ignoring)": (") IGNORE NULLS", " IGNORE NULLS)"), "@list(": ("collect_list(", "list("), "@sum_abs_from": ("aggregate(transform(arr, e -> abs(e - m)), CAST(0 AS DOUBLE), (a, e) -> a + e)", "list_sum(list_transform(arr, lambda e: abs(e - m)))")}


def _rows(n: int, by: str = "PARTITION BY code ") -> str:
    return f"({by}ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(what: str, x: str, n: int, by: str = "PARTITION BY code ") -> str:
    """An aggregate over a window that must be full."""
    return f"CASE WHEN count({x}) OVER {_rows(n, by)} = {n} THEN {what}({x}) OVER {_rows(n, by)} END"


def _sum(x: str, n: int) -> str:
    return _full("sum", x, n)


def _rank(x: str) -> str:
    """Average rank on a date."""
    return f"rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / CAST(2 AS DOUBLE)"


_TP = "(high + low + close) / 3"
_TRADED = "traded AS (SELECT * FROM {bars} WHERE close IS NOT NULL)"
#: f is the five-row momentum, g the volume against its mean, h the day's move; r is the next row's return.
_FACTORS = f"""fac AS (
  SELECT date, code, industry, cap, close / nullif(lag(close, 5) OVER {_STEP}, CAST(0 AS DOUBLE)) - 1 AS f, volume / nullif(avg(volume) OVER {_rows(10)}, CAST(0 AS DOUBLE)) AS g, close / nullif(open, CAST(0 AS DOUBLE)) - 1 AS h,
         lead(close, 1) OVER {_STEP} / nullif(close, CAST(0 AS DOUBLE)) - 1 AS r
  FROM {{bars}}
)"""
_IC = f"""{_FACTORS}, pairs AS (SELECT date, f, r FROM fac WHERE f IS NOT NULL AND r IS NOT NULL), ranked AS (SELECT date, {_rank('f')} AS x, {_rank('r')} AS y FROM pairs),
ic AS (SELECT date, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), CAST(0 AS DOUBLE)), 12) AS ic FROM ranked GROUP BY date HAVING count(*) >= 5)"""
_EQUITY = "equity AS (SELECT date, max(bm_close) AS v, max(bm_open) AS b FROM {bars} GROUP BY date)"
_RETURNS = f"{_EQUITY}, ret AS (SELECT date, v, v / lag(v) OVER (ORDER BY date) - 1 AS r, b / lag(b) OVER (ORDER BY date) - 1 AS q, max(v) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM equity)"
#: Odd orders buy, even ones sell; the k-th buy of a customer meets the k-th sale.
_PAIRED = """sides AS (
  SELECT o_custkey AS code, o_orderdate AS at, o_totalprice AS amount, o_orderkey % 2 AS buys, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderdate, o_orderkey) AS k FROM {orders}
), paired AS (
  SELECT b.code, b.k, b.amount AS paid, s.amount AS got, s.amount - b.amount AS pnl FROM sides b JOIN sides s ON s.code = b.code AND s.k = b.k WHERE b.buys = 1 AND s.buys = 0
)"""
#: A batch that repeats every fourth week with doubled volume and brings new codes.
_BATCH = f"{_TRADED}, old AS (SELECT code, date, close, volume FROM traded WHERE code % 5 <> 0), batch AS (SELECT code, date, volume * 2 AS volume FROM traded WHERE code % 4 = 0)"

#: Query name: (SQL text, digits to which each of its doubles is rounded).
_TEXTS: dict[str, tuple[str, dict[str, int]]] = {
    "ind_ma": (f"SELECT date, code, {', '.join(f'{_full('avg', 'close', n)} AS ma{n}' for n in (5, 10, 20, 60))} FROM {{bars}}", dict.fromkeys(("ma5", "ma10", "ma20", "ma60"), 6)),
    "ind_boll": (f"WITH b AS (SELECT date, code, close, {_full('avg', 'close', 20)} AS mid, {_full('stddev_pop', 'close', 20)} AS s FROM {{bars}}) SELECT date, code, mid, mid - 2 * s AS lower, mid + 2 * s AS upper, 400 * s / nullif(mid, CAST(0 AS DOUBLE)) AS bandwidth, (close - mid + 2 * s) / nullif(4 * s, CAST(0 AS DOUBLE)) AS pct_b FROM b", dict.fromkeys(("mid", "lower", "upper", "bandwidth", "pct_b"), 6)),
    "ind_kdj": (f"WITH a AS (SELECT date, code, 100 * (close - {_full('min', 'low', 9)}) / nullif({_full('max', 'high', 9)} - {_full('min', 'low', 9)}, CAST(0 AS DOUBLE)) AS fast FROM {{bars}}), b AS (SELECT date, code, {_full('avg', 'fast', 3)} AS k FROM a), c AS (SELECT date, code, k, {_full('avg', 'k', 3)} AS d FROM b) SELECT date, code, k, d, 3 * k - 2 * d AS j FROM c", dict.fromkeys("kdj", 6)),
    "ind_cci": (f"WITH a AS (SELECT date, code, {_TP} AS tp FROM {{bars}}), b AS (SELECT date, code, tp, {_full('avg', 'tp', 14)} AS m, @list(tp) OVER {_rows(14)} AS arr FROM a) SELECT date, code, CASE WHEN m IS NOT NULL THEN (tp - m) / nullif(0.015 * (@sum_abs_from) / 14, CAST(0 AS DOUBLE)) END AS cci FROM b", {"cci": 6}),
    "ind_willr": (f"SELECT date, code, 100 * ((close - {_full('min', 'low', 14)}) / nullif({_full('max', 'high', 14)} - {_full('min', 'low', 14)}, CAST(0 AS DOUBLE)) - 1) AS willr FROM {{bars}}", {"willr": 6}),
    "ind_true_range": (f"WITH a AS (SELECT date, code, high, low, lag(close) OVER {_STEP} AS before FROM {{bars}}) SELECT date, code, CASE WHEN before IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, abs(high - before), abs(low - before)) END AS true_range FROM a", {"true_range": 8}),
    "ind_historical_volatility": (f"WITH a AS (SELECT date, code, ln(close / lag(close) OVER {_STEP}) AS x FROM {{bars}}) SELECT date, code, {_full('stddev_samp', 'x', 20)} * sqrt(CAST(252 AS DOUBLE)) AS volatility FROM a", {"volatility": 6}),
    "ind_obv": (f"WITH a AS (SELECT date, code, CASE WHEN lag(close) OVER {_STEP} IS NULL THEN volume ELSE sign(close - lag(close) OVER {_STEP}) * volume END AS x FROM {{bars}}) SELECT date, code, sum(x) OVER {_SINCE} AS obv FROM a", {"obv": 2}),
    "ind_vwap": (f"WITH a AS (SELECT date, code, date_trunc('month', date) AS anchor, {_TP} * volume AS x, volume FROM {{bars}}) SELECT date, code, sum(x) OVER (PARTITION BY code, anchor ORDER BY date) / nullif(sum(volume) OVER (PARTITION BY code, anchor ORDER BY date), CAST(0 AS DOUBLE)) AS vwap FROM a", {"vwap": 6}),
    "ind_ad": (f"WITH a AS (SELECT date, code, coalesce((2 * close - high - low) / nullif(high - low, CAST(0 AS DOUBLE)), 0) * volume AS x FROM {{bars}}) SELECT date, code, sum(x) OVER {_SINCE} AS ad FROM a", {"ad": 4}),
    "ind_mfi": (f"WITH a AS (SELECT date, code, {_TP} AS tp, volume FROM {{bars}}), b AS (SELECT date, code, tp * volume AS flow, tp - lag(tp) OVER {_STEP} AS step FROM a), c AS (SELECT date, code, CASE WHEN step IS NOT NULL THEN CASE WHEN step > 0 THEN flow ELSE 0 END END AS up, CASE WHEN step IS NOT NULL THEN CASE WHEN step < 0 THEN flow ELSE 0 END END AS down FROM b) SELECT date, code, 100 * ({_sum('up', 14)}) / nullif(({_sum('up', 14)}) + ({_sum('down', 14)}), CAST(0 AS DOUBLE)) AS mfi FROM c", {"mfi": 6}),
    # cleaning and storage
    "clean_fill_forward": (f"SELECT date, code, @known(close@ignoring) OVER {_SINCE} AS close, @known(volume@ignoring) OVER {_SINCE} AS volume FROM {{bars}}", {"close": 8, "volume": 2}),
    "clean_outliers": ("SELECT date, code, ret FROM {bars} WHERE abs(ret) > (SELECT CASE WHEN max(ret) > 1 THEN 11.0 ELSE 0.11 END FROM {bars})", {"ret": 6}),
    "clean_remove_suspended": ("SELECT date, code, close, volume FROM {bars} WHERE volume > 0", {"close": 8, "volume": 2}),
    "clean_drop_invalid": (f"WITH {_TRADED}, bad AS (SELECT DISTINCT code FROM traded WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR volume < 0 OR amount < 0) SELECT date, code, close FROM traded WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.code = traded.code)", {"close": 8}),
    "clean_price_consistency": (f"WITH {_TRADED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE close <= 0) AS n_not_positive, count(*) FILTER (WHERE vwap < 0.99 * low OR vwap > 1.01 * high) AS n_vwap_outside, count(*) FILTER (WHERE high < low) AS n_crossed FROM traded", {}),
    "store_insert_or_ignore": (f"WITH {_BATCH} SELECT code, date, volume FROM old UNION ALL SELECT code, date, volume FROM batch WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.code = batch.code AND old.date = batch.date)", {"volume": 2}),
    "store_upsert": (f"WITH {_BATCH} SELECT batch.code, batch.date, old.close, batch.volume FROM batch LEFT JOIN old ON old.code = batch.code AND old.date = batch.date UNION ALL SELECT code, date, close, volume FROM old WHERE NOT EXISTS (SELECT 1 FROM batch WHERE old.code = batch.code AND old.date = batch.date)", {"close": 8, "volume": 2}),
    "store_date_ranges": (f"WITH {_TRADED} SELECT code, min(date) AS data_start, max(date) AS data_end FROM traded GROUP BY code", {}),
    "store_market_cap": (f"WITH {_TRADED} SELECT code, max_by(close, date) * max(cap) AS market_cap FROM traded GROUP BY code", {"market_cap": 2}),
    "store_price_adjustment": (f"WITH {_TRADED}, a AS (SELECT date, code, close, CAST(1 + year(date) % 4 AS DOUBLE) AS adj FROM traded) SELECT date, code, close * adj AS hfq, close * adj / max(adj) OVER (PARTITION BY code) AS qfq FROM a", {"hfq": 8, "qfq": 8}),
    "ingest_asof_factor": (f"WITH {_TRADED}, e AS (SELECT date, code, CASE WHEN date = min(date) OVER (PARTITION BY code, year(date)) AND year(date) % 2 = 0 THEN CAST(year(date) AS DOUBLE) / 2000 END AS factor FROM traded) SELECT date, code, coalesce(@known(factor@ignoring) OVER {_SINCE}, CAST(1 AS DOUBLE)) AS factor FROM e", {"factor": 6}),
    # universe: nations stand for boards, negative balances for delisted codes
    "universe_codes": ("SELECT s_suppkey AS code FROM {supplier} WHERE s_nationkey < 20 AND s_nationkey NOT IN (3, 7) AND upper(s_name) NOT LIKE '%ST%' AND s_acctbal >= 0 AND s_nationkey IS NOT NULL", {}),
    "universe_list_date": (f"WITH {_TRADED}, span AS (SELECT code, min(date) AS listed, max(date) AS gone FROM traded GROUP BY code) SELECT code FROM span WHERE listed <= DATE '1999-12-31' AND gone >= DATE '1997-01-01'", {}),
    # factor evaluation
    "eval_forward_returns": (f"WITH {_FACTORS} SELECT date, code, r FROM fac", {"r": 6}),
    "eval_ic_series": (f"WITH {_IC} SELECT date, ic FROM ic", {"ic": 6}),
    "eval_ir": (f"WITH {_IC} SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), CAST(0 AS DOUBLE)), 0) AS ic_ir, avg(CASE WHEN ic > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS ic_pos_ratio, count(*) AS n_periods FROM ic", dict.fromkeys(("ic_mean", "ic_std", "ic_ir", "ic_pos_ratio"), 6)),
    "eval_factor_return": (f"WITH {_FACTORS} SELECT date, CASE WHEN count(*) >= 10 THEN coalesce(regr_slope(r, f) * stddev_pop(f), 0) ELSE CAST(0 AS DOUBLE) END AS factor_return FROM fac WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY date", {"factor_return": 6}),
    "eval_quantile_returns": (f"WITH {_FACTORS}, p AS (SELECT date, f, r FROM fac WHERE f IS NOT NULL AND r IS NOT NULL), q AS (SELECT date, {', '.join(f'@pct(f, 0.{2 * k}) AS q{k}' for k in (1, 2, 3, 4))} FROM p GROUP BY date), g AS (SELECT p.date, r, 1 + {' + '.join(f'CASE WHEN f > q{k} THEN 1 ELSE 0 END' for k in (1, 2, 3, 4))} AS bucket FROM p JOIN q ON q.date = p.date) SELECT date, bucket, avg(r) AS mean_return, count(*) AS n FROM g GROUP BY date, bucket", {"mean_return": 6}),
    "eval_neutralize": (f"WITH {_FACTORS}, p AS (SELECT date, code, industry, f, ln(cap) AS c FROM fac WHERE f IS NOT NULL AND cap > 0), m AS (SELECT date, code, f, f - avg(f) OVER (PARTITION BY date, industry) AS x, c - avg(c) OVER (PARTITION BY date, industry) AS z FROM p) SELECT date, code, CASE WHEN count(*) OVER (PARTITION BY date) < 10 THEN f ELSE x - coalesce(sum(x * z) OVER (PARTITION BY date) / nullif(sum(z * z) OVER (PARTITION BY date), CAST(0 AS DOUBLE)), 0) * z END AS residual FROM m", {"residual": 6}),
    "eval_combine_equal": (f"WITH {_FACTORS}, z AS (SELECT date, code, {', '.join(f'({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), CAST(0 AS DOUBLE)) AS z{x}' for x in 'fgh')} FROM fac) SELECT date, code, (coalesce(zf, 0) + coalesce(zg, 0) + coalesce(zh, 0)) / nullif(CAST({' + '.join(f'CASE WHEN z{x} IS NULL THEN 0 ELSE 1 END' for x in 'fgh')} AS DOUBLE), CAST(0 AS DOUBLE)) AS combined FROM z", {"combined": 6}),
    "eval_correlation": (f"WITH {_FACTORS}, s AS (SELECT date, {', '.join(f'CASE WHEN count({x} + r) >= 10 AND stddev_pop(CASE WHEN r IS NOT NULL THEN {x} END) > 1e-12 THEN regr_slope(r, {x}) * stddev_pop(CASE WHEN r IS NOT NULL THEN {x} END) END AS {x}' for x in 'fgh')} FROM fac GROUP BY date) SELECT corr(f, g) AS f_g, corr(f, h) AS f_h, corr(g, h) AS g_h FROM s", dict.fromkeys(("f_g", "f_h", "g_h"), 6)),
    "eval_coverage": (f"WITH {_FACTORS}, d AS (SELECT date, count(f) AS nf, count(g) AS ng, count(h) AS nh FROM fac GROUP BY date) SELECT {', '.join(f'avg(CASE WHEN n{x} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS {x}' for x in 'fgh')} FROM d", dict.fromkeys("fgh", 6)),
    "strategy_top_k": (f"WITH {_FACTORS}, o AS (SELECT date, code, f, row_number() OVER (PARTITION BY date ORDER BY f DESC, code) AS place FROM fac WHERE f IS NOT NULL) SELECT date, code, place, 1 / CAST(least(10, count(*) OVER (PARTITION BY date)) AS DOUBLE) AS weight FROM o WHERE place <= 10", {"weight": 6}),
    # performance and risk
    "perf_summary": (f"WITH {_RETURNS}, t AS (SELECT max_by(v, date) / min_by(v, date) - 1 AS total_return, count(*) AS n, stddev_samp(r) * sqrt(CAST(252 AS DOUBLE)) AS volatility, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(CAST(252 AS DOUBLE)) AS downside, max((peak - v) / peak) AS max_drawdown, @pct(r, 0.05) AS var_95, covar_samp(r, q) / nullif(var_samp(q), CAST(0 AS DOUBLE)) AS beta FROM ret), a AS (SELECT *, pow(1 + total_return, CAST(252 AS DOUBLE) / n) - 1 AS annual FROM t) SELECT total_return, annual, annual - 0.03 AS alpha, beta, volatility, max_drawdown, var_95, (annual - 0.03) / nullif(volatility, CAST(0 AS DOUBLE)) AS sharpe, (annual - 0.03) / nullif(downside, CAST(0 AS DOUBLE)) AS sortino, annual / nullif(max_drawdown, CAST(0 AS DOUBLE)) AS calmar FROM a", dict.fromkeys(("total_return", "annual", "alpha", "beta", "volatility", "max_drawdown", "var_95", "sharpe", "sortino", "calmar"), 6)),
    "perf_drawdown_duration": (f"WITH {_RETURNS}, i AS (SELECT date, v < peak AS below, sum(CASE WHEN v < peak THEN 0 ELSE 1 END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ret), g AS (SELECT island, count(*) FILTER (WHERE below) AS n FROM i GROUP BY island) SELECT max(n) AS duration FROM g", {}),
    "perf_rolling_beta": (f"WITH {_RETURNS} SELECT date, CASE WHEN count(r + q) OVER {_rows(60, '')} >= 5 THEN covar_samp(r, q) OVER {_rows(60, '')} / nullif(var_samp(q) OVER {_rows(60, '')}, CAST(0 AS DOUBLE)) END AS beta FROM ret WHERE r IS NOT NULL", {"beta": 6}),
    "perf_excess": (f"WITH {_RETURNS} SELECT date, r - q AS excess, exp(sum(CASE WHEN r - q > -1 THEN ln(1 + r - q) END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS cumulative FROM ret WHERE r IS NOT NULL", {"excess": 6, "cumulative": 6}),
    "perf_paired_trades": (f"WITH {_PAIRED} SELECT code, k, paid, got, pnl FROM paired", {"paid": 2, "got": 2, "pnl": 2}),
    "perf_trade_statistics": (f"WITH {_PAIRED} SELECT count(*) AS n_trades, count(*) FILTER (WHERE pnl > 0) AS n_wins, count(*) FILTER (WHERE pnl > 0) / CAST(nullif(count(*), 0) AS DOUBLE) AS win_rate, sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0) AS profit_factor, avg(CASE WHEN pnl > 0 THEN pnl END) / nullif(-avg(CASE WHEN pnl < 0 THEN pnl END), 0) AS payoff FROM paired", {"win_rate": 6, "profit_factor": 6, "payoff": 6}),
    "risk_monitor": (f"WITH {_RETURNS}, d AS (SELECT date, (peak - v) / peak AS drawdown FROM ret) SELECT date, drawdown, CASE WHEN drawdown >= 0.10 THEN 'RED' WHEN drawdown >= 0.07 THEN 'ORANGE' WHEN drawdown >= 0.04 THEN 'YELLOW' ELSE 'GREEN' END AS level, CAST(CASE WHEN drawdown >= 0.10 THEN 0.3 WHEN drawdown >= 0.07 THEN 0.6 WHEN drawdown >= 0.04 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS scale FROM d", {"drawdown": 6}),
}


def run(name: str, **frames: DataFrame) -> DataFrame:
    """One operator over frames given by the input's name."""
    text = _shown(name)
    for mark, (ours, _) in _NAMES.items():
        text = text.replace(mark, ours)
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(text, **{k: v for k, v in frames.items() if f"{{{k}}}" in text})


def _shown(name: str) -> str:
    """The text with its doubles rounded by an outer select."""
    text, digits = _TEXTS[name]
    if not digits:
        return text
    return f"SELECT * EXCEPT ({', '.join(digits)}), {', '.join(f'round({c}, {n}) AS {c}' for c, n in digits.items())} FROM ({text}) shown"


def _query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, frames = _TEXTS[name][0], {}
        if "{bars}" in text:
            frames["bars"] = weekly_bars(spark, sf_dir)
        for table in ("supplier", "orders"):
            if f"{{{table}}}" in text:
                frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return run(name, **frames)

    return query


def queries() -> dict:
    return {name: _query(name) for name in _TEXTS}


def duck_sql(name: str) -> str:
    text = _shown(name).replace("* EXCEPT (", "* EXCLUDE (")
    for mark, (_, theirs) in _NAMES.items():
        text = text.replace(mark, theirs)
    text = text.replace("{bars}", "bars").replace("{supplier}", "supplier").replace("{orders}", "orders")
    return f"WITH bars AS MATERIALIZED ({DUCK_BARS}) {text if text.startswith('SELECT') else 'SELECT * FROM (' + text + ')'}" if "{bars}" in _TEXTS[name][0] else text


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(name) for name in _TEXTS}
