"""Queries of the parametrised operators over the weekly bars, with SQL written apart from them.

Factors of the studies: f, the five-row momentum; g, volume against its ten-row mean; h,
the row's move; r is the next row's return. Curves are the benchmark (value: mean close,
bench: return of the mean open); trades are orders, odd keys buying and even ones selling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.backtest import engine, risk
from barloom.operators import cleaning, evaluation, indicators, performance, universe
from barloom.sources.bars import DUCK_BARS, weekly_bars

FACTORS = ["f", "g", "h"]
DIGITS = 6


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("code").orderBy("date")
    bars = evaluation.forward_returns(weekly_bars(spark, sf_dir))
    return bars.select(
        "date", "code", "close", "industry", "cap", "r", (F.col("close") / F.nullif(F.lag("close", 5).over(w), F.lit(0.0)) - 1).alias("f"),
        (F.col("volume") / F.nullif(F.avg("volume").over(w.rowsBetween(-9, 0)), F.lit(0.0))).alias("g"), (F.col("close") / F.nullif("open", F.lit(0.0)) - 1).alias("h"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = weekly_bars(spark, sf_dir).groupBy("date").agg(F.max("bm_close").alias("value"), F.max("bm_open").alias("b"))
    return days.select(F.lit("bm").alias("run"), "date", "value", (F.col("b") / F.lag("b").over(Window.orderBy("date")) - 1).alias("bench"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.lit("all").alias("run"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderkey") % 2 == 1, "buy").otherwise("sell").alias("direction"), F.col("o_totalprice").cast("double").alias("price"), F.lit(1).alias("quantity"), F.lit(5.0).alias("commission"))


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    nudge = 2.5e-9 if digits == 6 else 0.0
    return df.withColumns({f.name: F.round(F.col(f.name) + nudge, digits) for f in df.schema.fields if f.dataType.simpleString() == "double"})


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return evaluation.long(_study(s, d), FACTORS, ["date", "code", "r"])


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as listed codes: the key in six digits, the nation as industry, a negative balance as delisted."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("industry"), F.lit(None).cast("date").alias("list_date"), F.lit(None).cast("date").alias("out_date"), F.when(F.col("s_acctbal") < 0, 0).otherwise(1).alias("status"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir).select("date", "code", "close")
    return engine.run_all(bars, engine.grid(spark, "dual_average", short=[3, 5], long=[10, 20]))


def _top(trades: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = _study(spark, sf_dir).select("date", "code", "close", F.col("f").alias("factor"))
        return engine.run_all(bars, engine.grid(spark, "top_factor", top=[5, 10], every=[4]), ["close", "factor"], trades=trades)

    return query


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = engine.summary(_runs(spark, sf_dir))
    part = lambda k: F.regexp_extract("run", rf"{k}=([0-9]+)", 1).cast("int")
    return told.select(part("short").alias("short"), part("long").alias("long"), "sharpe").groupBy("short").pivot("long", [10, 20]).agg(F.first("sharpe")).withColumnsRenamed({"10": "long_10", "20": "long_20"})


QUERIES = {
    "study_evaluate": lambda s, d: _rounded(evaluation.evaluate(_study(s, d).drop("r"), FACTORS, limit=None, neutral=False)),
    "study_evaluate_limit": lambda s, d: _rounded(evaluation.evaluate(_study(s, d).drop("r"), FACTORS, limit=0.5, neutral=False)),
    "study_neutral": lambda s, d: evaluation.evaluate(_study(s, d).drop("r"), FACTORS, limit=None),
    "study_ic_pearson": lambda s, d: _rounded(evaluation.ic_series(_pairs(s, d), "pearson")),
    "study_factor_returns": lambda s, d: _rounded(evaluation.rolling_factor_returns(_pairs(s, d))),
    "study_rolling_means": lambda s, d: _rounded(evaluation.rolling_means(evaluation.rolling_factor_returns(_pairs(s, d)), 20)),
    "study_ic_decay": lambda s, d: _rounded(evaluation.ic_decay(evaluation.evaluate_horizons(_study(s, d).drop("r"), FACTORS, (1, 2, 3), limit=None, neutral=False), (1, 2, 3))),
    "study_coverage": lambda s, d: _rounded(evaluation.coverage(_study(s, d), FACTORS)),
    "study_coverage_report": lambda s, d: _rounded(evaluation.coverage_report(_study(s, d), FACTORS).drop("low_coverage_factors")),
    "study_cell_coverage": lambda s, d: _rounded(evaluation.cell_coverage(_study(s, d), FACTORS)),
    "study_correlation": lambda s, d: _rounded(evaluation.correlation(evaluation.factor_returns(_pairs(s, d)))),
    "study_redundant_pairs": lambda s, d: _rounded(evaluation.redundant_pairs(evaluation.correlation(evaluation.factor_returns(_pairs(s, d))), 0.05)),
    "study_quantiles": lambda s, d: _rounded(evaluation.quantile_returns(_study(s, d), "f", 4)),
    "study_combine_equal": lambda s, d: _rounded(evaluation.combine_equal(_study(s, d), FACTORS).select("date", "code", "combined")),
    "study_combine_icir": lambda s, d: _rounded(evaluation.combine_icir(_study(s, d), {"f": -0.5, "g": 0.2, "h": 0.3}).select("date", "code", "combined")),
    "study_combine_rank": lambda s, d: _rounded(evaluation.combine_rank(_study(s, d), FACTORS).select("date", "code", "combined")),
    "study_model_power": lambda s, d: _rounded(evaluation.model_power(_study(s, d), {"f": 0.5, "h": 0.5})),
    "study_factor_count": lambda s, d: _rounded(evaluation.factor_count(_study(s, d), {"f": 0.1, "g": -0.3, "h": 0.2})),
    "study_style_factors": lambda s, d: evaluation.style_factors(weekly_bars(s, d), window=104, far=126),
    "study_regresi": lambda s, d: evaluation.regression_residuals(_study(s, d).select("date", "code", "f", "g", "h"), "f", ["g", "h"], 30),
    "perf_curve_summary": lambda s, d: _rounded(performance.summary(_curve(s, d))),
    "perf_against_benchmark": lambda s, d: _rounded(performance.against_benchmark(_curve(s, d))),
    "perf_report": lambda s, d: performance.report(performance.summary(_curve(s, d))),
    "perf_monthly": lambda s, d: _rounded(performance.monthly_returns(_curve(s, d))),
    "perf_trades_paired": lambda s, d: _rounded(performance.pair_trades(_trades(s, d)), 2).drop("pnl_pct"),
    "perf_trade_streaks": lambda s, d: _rounded(performance.trade_statistics(performance.pair_trades(_trades(s, d))), 4),
    "perf_trade_alpha": lambda s, d: performance.trade_alpha(performance.pair_trades(_trades(s, d)), _curve(s, d).withColumn("run", F.lit("all"))),
    "perf_trade_summary": lambda s, d: performance.trade_summary(_trades(s, d)).drop("commission", "mean_price"),
    "risk_regimes": lambda s, d: risk.regimes(_curve(s, d), ["run"], "value").select("date", "regime", "scale"),
    "clean_interpolate": lambda s, d: _rounded(cleaning.fill_missing(weekly_bars(s, d).select("date", "code", "close"), "interpolate", ["close"])),
    "clean_whole_codes": lambda s, d: cleaning.drop_invalid(weekly_bars(s, d).select("date", "code", "open", "high", "low", "close", "volume", "amount").where("date < DATE '1992-03-01' OR close IS NOT NULL")).select("date", "code"),
    "clean_checks": lambda s, d: cleaning.price_checks(weekly_bars(s, d).where("close IS NOT NULL").withColumn("pre_close", F.col("open"))),
    "clean_pipeline": lambda s, d: _rounded(cleaning.clean(weekly_bars(s, d).where("close IS NOT NULL").drop("vwap")).select("date", "code", "close", "volume", "vwap")),
    "universe_scope": lambda s, d: universe.Universe(_info(s, d)).scope(universe.Pool.SZ_MAIN, ["600001"]).exclude(["000005", "000007"]).codes(),
    "universe_summary": lambda s, d: universe.summary(weekly_bars(s, d)),
    "most_expensive": lambda s, d: _rounded(weekly_bars(s, d).groupBy("code").agg(F.min("close").alias("low"), F.max("close").alias("high"), F.count("close").alias("n"), F.avg("close").alias("mean")).orderBy(F.desc("mean"), "code").limit(10)),
    **{f"ind_family_{k}": (lambda s, d, k=k: _rounded(indicators.family(k, weekly_bars(s, d)))) for k in indicators.FAMILIES},
    "bt_grid": _runs,
    "bt_grid_summary": lambda s, d: engine.summary(_runs(s, d)),
    "bt_heat_map": _heat,
    "bt_top_factor": _top(False),
    "bt_top_factor_trades": _top(True),
}

_FAC = f"""WITH bars AS MATERIALIZED ({DUCK_BARS}), held AS (
  SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hc FROM bars
), fac AS MATERIALIZED (
  SELECT date, code, close, hc, close / nullif(lag(close, 5) OVER w, 0) - 1 AS f, volume / nullif(avg(volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS g, close / nullif(open, 0) - 1 AS h,
         lead(hc) OVER w / nullif(hc, 0) - 1 AS r, abs(close / nullif(lag(close) OVER w, 0) - 1) < 0.5 AS ok
  FROM held WINDOW w AS (PARTITION BY code ORDER BY date)
)"""
_LONG = ", long AS MATERIALIZED (SELECT * FROM (SELECT date, code, r, f, g, h FROM {src}) UNPIVOT INCLUDE NULLS (value FOR factor IN (f, g, h)))"
_RANKED = """, ranked AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0 AS x, rank() OVER (PARTITION BY factor, date ORDER BY r) + (count(*) OVER (PARTITION BY factor, date, r) - 1) / 2.0 AS y FROM {src} WHERE value IS NOT NULL AND r IS NOT NULL),
ic AS (SELECT factor, date, round(corr(x, y), 12) AS ic FROM ranked GROUP BY factor, date HAVING count(*) >= 2 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12)"""
_FR = """, mom AS (SELECT factor, date, avg(value) AS m, stddev_pop(value) AS s, avg(r) AS rm FROM long GROUP BY factor, date),
fr AS MATERIALIZED (SELECT factor, date, sum((value - m) / s * (r - rm)) / (count(*) - 1) AS fr, count(*) AS n FROM long JOIN mom USING (factor, date) WHERE value IS NOT NULL AND r IS NOT NULL AND s > 0 GROUP BY factor, date HAVING count(*) >= 10)"""
_MEASURES = """ SELECT factor, {ic_mean} AS ic_mean, {ic_std} AS ic_std, {ic_ir} AS ic_ir, {pos} AS ic_pos_ratio, {fr_mean} AS fr_mean, {fr_std} AS fr_std, {fr_ir} AS fr_ir, {fr_annual} AS fr_annual, {t} AS t_stat, coalesce(n, 0) AS n_periods
FROM (SELECT factor, avg(ic) AS im, stddev_samp(ic) AS si, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS pos FROM ic GROUP BY factor) FULL JOIN (SELECT factor, avg(fr) AS fm, stddev_samp(fr) AS sf, count(*) AS n FROM fr GROUP BY factor) USING (factor)"""


def _r(x: str, digits: int = DIGITS) -> str:
    return f"round({x} + {'2.5e-9' if digits == 6 else '0.0'}, {digits})"


_TOLD = _MEASURES.format(ic_mean=_r("im"), ic_std=_r("si"), ic_ir=_r("im / si"), pos=_r("pos"), fr_mean=_r("fm"), fr_std=_r("sf"), fr_ir=_r("fm / sf"), fr_annual=_r("fm * 252"), t=_r("im / (si / sqrt(n))"))
_LIMITED = ", lim AS (SELECT date, code, CASE WHEN ok THEN f END AS f, CASE WHEN ok THEN g END AS g, CASE WHEN ok THEN h END AS h, CASE WHEN lead(ok) OVER (PARTITION BY code ORDER BY date) THEN r END AS r FROM fac)"
_FR20 = _FR.replace("count(*) >= 10", "count(*) >= 20") + ", full_days AS (SELECT date FROM fr GROUP BY date HAVING count(*) = 3), kept AS (SELECT factor, date, fr FROM fr JOIN full_days USING (date))"
_Z = ", z AS (SELECT date, code, " + ", ".join(f"({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0) AS z{c}" for c in "fgh") + " FROM fac WINDOW d AS (PARTITION BY date))"
_KNOWN = " + ".join(f"(CASE WHEN z{c} IS NULL THEN 0 ELSE 1 END)" for c in "fgh")
_CODE_Z = ", zc AS (SELECT date, code, r, " + ", ".join(f"({c} - avg({c}) OVER d) / (stddev_samp({c}) OVER d + 1e-10) AS z{c}" for c in "fgh") + " FROM fac WINDOW d AS (PARTITION BY code))"
_CURVE = f"WITH bars AS MATERIALIZED ({DUCK_BARS}), days AS (SELECT date, max(bm_close) AS v, max(bm_open) AS b FROM bars GROUP BY date), c AS MATERIALIZED (SELECT date, v, v / lag(v) OVER (ORDER BY date) - 1 AS r, b / lag(b) OVER (ORDER BY date) - 1 AS q, max(v) OVER (ORDER BY date) AS peak FROM days)"
_PAIRS = """WITH t AS (SELECT o_orderkey AS seq, o_custkey AS code, CAST(o_orderdate AS DATE) AS date, o_orderkey % 2 = 1 AS buys, CAST(o_totalprice AS DOUBLE) AS price, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY CAST(o_orderdate AS DATE), o_orderkey, o_totalprice) AS k FROM orders),
p AS MATERIALIZED (SELECT a.code, a.k, a.date AS buy_date, z.date AS sell_date, a.price AS buy_value, z.price AS sell_value, z.price - a.price - 10 AS pnl, date_diff('day', a.date, z.date) AS holding_days FROM t a JOIN t z ON a.code = z.code AND a.k = z.k WHERE a.buys AND NOT z.buys)"""


def _decay() -> str:
    parts = " UNION ALL ".join(f"SELECT date, code, {p} AS period, lead(hc, {p}) OVER (PARTITION BY code ORDER BY date) / nullif(hc, 0) - 1 AS r, f, g, h FROM fac" for p in (1, 2, 3))
    return _FAC + f""", hor AS ({parts}), long AS (SELECT * FROM hor UNPIVOT INCLUDE NULLS (value FOR factor IN (f, g, h))),
ranked AS (SELECT factor, period, date, rank() OVER (PARTITION BY factor, period, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, period, date, value) - 1) / 2.0 AS x, rank() OVER (PARTITION BY factor, period, date ORDER BY r) + (count(*) OVER (PARTITION BY factor, period, date, r) - 1) / 2.0 AS y FROM long WHERE value IS NOT NULL AND r IS NOT NULL),
ic AS (SELECT factor, period, date, round(corr(x, y), 12) AS ic FROM ranked GROUP BY ALL HAVING count(*) >= 2 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12), m AS (SELECT factor, period, avg(ic) AS ic FROM ic GROUP BY ALL)
SELECT factor, {', '.join(_r(f'max(CASE WHEN period = {p} THEN ic END)') + f' AS ic_{p}' for p in (1, 2, 3))}, max_by(period, abs(ic)) AS peak FROM m GROUP BY factor"""


SQL = {
    "study_evaluate": _FAC + _LONG.format(src="fac") + _RANKED.format(src="long") + _FR + _TOLD,
    "study_evaluate_limit": _FAC + _LIMITED + _LONG.format(src="lim") + _RANKED.format(src="long") + _FR + _TOLD,
    "study_ic_pearson": _FAC + _LONG.format(src="fac") + f" SELECT factor, date, {_r('round(corr(value, r), 12)')} AS ic FROM long WHERE value IS NOT NULL AND r IS NOT NULL GROUP BY factor, date HAVING count(*) >= 5 AND stddev_pop(value) > 1e-12 AND stddev_pop(r) > 1e-12",
    "study_factor_returns": _FAC + _LONG.format(src="fac") + _FR20 + f" SELECT factor, date, {_r('fr')} AS fr FROM kept",
    "study_rolling_means": _FAC + _LONG.format(src="fac") + _FR20 + f" SELECT factor, date, {_r('fr')} AS fr, {_r('avg(fr) OVER (PARTITION BY factor ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS fr_mean FROM kept",
    "study_ic_decay": _decay(),
    "study_coverage": _FAC + f", d AS (SELECT date, max(CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END) AS f, max(CASE WHEN g IS NULL THEN 0.0 ELSE 1.0 END) AS g, max(CASE WHEN h IS NULL THEN 0.0 ELSE 1.0 END) AS h FROM fac GROUP BY date), a AS (SELECT avg(f) AS f, avg(g) AS g, avg(h) AS h FROM d) SELECT factor, {_r('coverage')} AS coverage FROM a UNPIVOT (coverage FOR factor IN (f, g, h))",
    "study_coverage_report": _FAC + f", d AS (SELECT date, max(CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END) AS f, max(CASE WHEN g IS NULL THEN 0.0 ELSE 1.0 END) AS g, max(CASE WHEN h IS NULL THEN 0.0 ELSE 1.0 END) AS h FROM fac GROUP BY date), a AS (SELECT avg(f) AS f, avg(g) AS g, avg(h) AS h FROM d) SELECT {_r('least(f, g, h)')} AS min_coverage, {_r('f + g + h - least(f, g, h) - greatest(f, g, h)')} AS median_coverage, {_r('greatest(f, g, h)')} AS max_coverage FROM a",
    "study_cell_coverage": _FAC + f", a AS (SELECT count(f) / count(*) AS f, count(g) / count(*) AS g, count(h) / count(*) AS h FROM fac) SELECT factor, {_r('coverage')} AS coverage FROM a UNPIVOT (coverage FOR factor IN (f, g, h)) WHERE coverage >= 0.3",
    "study_correlation": _FAC + _LONG.format(src="fac") + _FR + f" SELECT x.factor AS a, y.factor AS b, {_r('corr(x.fr, y.fr)')} AS corr FROM fr x JOIN fr y ON x.date = y.date GROUP BY x.factor, y.factor",
    "study_redundant_pairs": _FAC + _LONG.format(src="fac") + _FR + f" SELECT x.factor AS a, y.factor AS b, {_r('corr(x.fr, y.fr)')} AS corr FROM fr x JOIN fr y ON x.date = y.date AND x.factor < y.factor GROUP BY x.factor, y.factor HAVING abs(corr(x.fr, y.fr)) > 0.05",
    "study_quantiles": _FAC + f", p AS (SELECT date, f, r FROM fac WHERE f IS NOT NULL AND r IS NOT NULL), q AS (SELECT date, min(f) AS lo, max(f) AS hi, list_distinct(quantile_cont(f, [0.25, 0.5, 0.75])) AS inner_edges FROM p GROUP BY date), g AS (SELECT p.date, r, 1 + len(list_filter(inner_edges, lambda x: x > lo AND x < hi AND f > x)) AS bucket FROM p JOIN q USING (date)) SELECT date, bucket, {_r('avg(r)')} AS mean_return, count(*) AS n FROM g GROUP BY date, bucket",
    "study_combine_equal": _FAC + _Z + f" SELECT date, code, CASE WHEN {_KNOWN} >= 1 THEN {_r(f'(coalesce(zf, 0) + coalesce(zg, 0) + coalesce(zh, 0)) / ({_KNOWN})')} END AS combined FROM z",
    "study_combine_icir": _FAC + _Z + f" SELECT date, code, CASE WHEN {_KNOWN} >= 1 THEN {_r('coalesce(zf, 0) * 0.5 + coalesce(zg, 0) * 0.2 + coalesce(zh, 0) * 0.3')} END AS combined FROM z",
    "study_combine_rank": _FAC + ", z AS (SELECT date, code, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END AS z{c}" for c in "fgh") + f" FROM fac) SELECT date, code, CASE WHEN {_KNOWN} >= 1 THEN {_r(f'(coalesce(zf, 0) + coalesce(zg, 0) + coalesce(zh, 0)) / ({_KNOWN})')} END AS combined FROM z",
    "perf_against_benchmark": _CURVE + f""", s AS (SELECT date, r, q, CASE WHEN count(*) FILTER (WHERE r IS NOT NULL AND q IS NOT NULL) OVER w >= 5 THEN covar_samp(r, q) OVER w / nullif(var_samp(CASE WHEN r IS NOT NULL THEN q END) OVER w, 0) END AS beta, covar_samp(r, q) OVER () / nullif(var_samp(CASE WHEN r IS NOT NULL THEN q END) OVER (), 0) AS whole FROM c WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
x AS (SELECT date, r - coalesce(q, 0) AS e, r - coalesce(beta, whole, 1) * coalesce(q, 0) AS a FROM s WHERE r IS NOT NULL) SELECT 'bm' AS run, date, {_r('e')} AS excess, {_r('a')} AS alpha, {_r('exp(sum(ln(1 + e)) OVER (ORDER BY date))')} AS cumulative_excess, {_r('exp(sum(ln(1 + a)) OVER (ORDER BY date))')} AS cumulative_alpha FROM x""",
    "perf_curve_summary": _CURVE + f""", i AS (SELECT v < peak AS under, sum(CASE WHEN v >= peak THEN 1 ELSE 0 END) OVER (ORDER BY date) AS g FROM c), u AS (SELECT max(n) AS duration FROM (SELECT count(*) FILTER (WHERE under) AS n FROM i GROUP BY g)),
m AS (SELECT max_by(v, date) / min_by(v, date) - 1 AS total, count(*) AS n, stddev_samp(r) * sqrt(252) AS vol, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS down, max((peak - v) / peak) AS dd, quantile_cont(r, 0.05) AS v5, exp(sum(ln(1 + q))) AS bt, count(q) AS nb, covar_samp(r, q) / var_samp(CASE WHEN r IS NOT NULL THEN q END) AS beta FROM c), y AS (SELECT *, pow(1 + total, 252.0 / n) - 1 AS annual FROM m)
SELECT 'bm' AS run, {_r('total')} AS total, {_r('annual')} AS annual, {_r('annual - (pow(bt, 252.0 / nb) - 1)')} AS alpha, {_r('beta')} AS beta, {_r('vol')} AS volatility, {_r('dd')} AS drawdown, duration, {_r('v5')} AS var, {_r('(annual - 0.03) / vol')} AS sharpe, {_r('(annual - 0.03) / down')} AS sortino, {_r('annual / dd')} AS calmar FROM y, u""",
    "perf_trades_paired": _PAIRS + " SELECT 'all' AS run, code, k, buy_date, sell_date, round(buy_value, 2) AS buy_value, round(sell_value, 2) AS sell_value, round(pnl, 2) AS pnl, holding_days FROM p",
    "perf_trade_summary": "SELECT o_custkey AS code, CASE WHEN o_orderkey % 2 = 1 THEN 'buy' ELSE 'sell' END AS direction, count(*) AS n, count(*) AS quantity FROM orders GROUP BY ALL",
    "perf_trade_streaks": _PAIRS + """, s AS (SELECT *, sign(pnl) AS sg, row_number() OVER (ORDER BY sell_date, code, k) AS i FROM p), g AS (SELECT *, i - row_number() OVER (PARTITION BY sg ORDER BY i) AS isl FROM s), runs AS (SELECT sg, isl, count(*) AS n FROM g GROUP BY sg, isl)
SELECT 'all' AS run, count(*) AS n_trades, count(*) FILTER (WHERE pnl > 0) AS n_wins, count(*) FILTER (WHERE pnl < 0) AS n_losses, round(avg(pnl) FILTER (WHERE pnl > 0), 4) AS mean_win, round(avg(pnl) FILTER (WHERE pnl < 0), 4) AS mean_loss, round(avg(holding_days) FILTER (WHERE pnl > 0), 4) AS win_days, round(avg(holding_days) FILTER (WHERE pnl < 0), 4) AS loss_days,
(SELECT max(n) FROM runs WHERE sg = 1) AS win_streak, (SELECT max(n) FROM runs WHERE sg = -1) AS loss_streak, round(count(*) FILTER (WHERE pnl > 0) / count(*), 4) AS win_rate, round(avg(pnl) FILTER (WHERE pnl > 0) / -avg(pnl) FILTER (WHERE pnl < 0), 4) AS payoff, round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 4) AS profit_factor FROM p""",
    "clean_whole_codes": f"WITH bars AS MATERIALIZED ({DUCK_BARS}), x AS (SELECT * FROM bars WHERE date < DATE '1992-03-01' OR close IS NOT NULL) SELECT date, code FROM x WHERE code NOT IN (SELECT code FROM x WHERE open IS NULL OR open <= 0 OR high IS NULL OR high <= 0 OR low IS NULL OR low <= 0 OR close IS NULL OR close <= 0 OR volume IS NULL OR volume < 0 OR amount IS NULL OR amount < 0)",
    "clean_checks": f"WITH bars AS MATERIALIZED ({DUCK_BARS}), x AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS b FROM bars WHERE close IS NOT NULL) SELECT count(*) AS n_rows, count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS n_not_positive, count(*) FILTER (WHERE vwap < 0.99 * low OR vwap > 1.01 * high) AS n_vwap_outside, count(*) FILTER (WHERE abs(open / b - 1) > 0.02) AS n_pre_close_off FROM x",
    "clean_pipeline": f"WITH bars AS MATERIALIZED ({DUCK_BARS}) SELECT date, code, {_r('close')} AS close, {_r('volume')} AS volume, {_r('amount / volume')} AS vwap FROM bars WHERE volume > 0",
    "clean_interpolate": f"""WITH bars AS MATERIALIZED ({DUCK_BARS}), n AS (SELECT date, code, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars), k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER b AS lo, first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER a AS hi, last_value(close IGNORE NULLS) OVER b AS x, first_value(close IGNORE NULLS) OVER a AS y FROM n WINDOW b AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT date, code, {_r('coalesce(close, x + (i - lo) / (hi - lo) * (y - x), x, y)')} AS close FROM k""",
    "universe_scope": "SELECT DISTINCT code FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name, s_acctbal, s_nationkey FROM supplier) WHERE substr(code, 1, 3) IN ('000', '001', '002', '003') AND code NOT IN ('000005', '000007') AND upper(s_name) NOT LIKE '%ST%' AND s_acctbal >= 0 UNION SELECT '600001'",
    "universe_summary": f"WITH bars AS MATERIALIZED ({DUCK_BARS}) SELECT count(DISTINCT code) AS n_codes, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first, max(date) AS last FROM bars",
    "most_expensive": f"WITH bars AS MATERIALIZED ({DUCK_BARS}) SELECT code, {_r('min(close)')} AS low, {_r('max(close)')} AS high, count(close) AS n, {_r('avg(close)')} AS mean FROM bars GROUP BY code ORDER BY avg(close) DESC, code LIMIT 10",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
