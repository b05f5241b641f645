"""Factor evaluation over long frames: date, code, any number of factor columns, a return column.

Cross-sections are windows or aggregates by date; only the regression of many columns
on industries and styles is a grouped map by date (a group is one cross-section) and
the exponentially weighted style factors one by code (a group is one history).
Tables of a row per factor, or pair of factors, are small by construction.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def _day() -> Window:
    return Window.partitionBy("date")


def _ahead(*by: str) -> Window:
    return Window.partitionBy(*(by or ("code",))).orderBy("date")


def forward_returns(bars: DataFrame, period: int = 1, price: str = "close", out: str = "r") -> DataFrame:
    """Adds the return of the next `period` rows; a missing price counts as the last known one."""
    since = _ahead().rowsBetween(Window.unboundedPreceding, 0)
    held = bars.withColumn("held_", F.last(price, ignorenulls=True).over(since))
    return held.withColumn(out, F.lead("held_", period).over(_ahead()) / F.nullif("held_", F.lit(0.0)) - 1).drop("held_")


def within_limit(bars: DataFrame, columns: list[str], price: str = "close", limit: float = 0.095) -> DataFrame:
    """Nulls the columns on rows whose price moved by `limit` or more since the row before, or has none before."""
    move = F.abs(F.col(price) / F.nullif(F.lag(price).over(_ahead()), F.lit(0.0)) - 1)
    ok = bars.withColumn("ok_", F.coalesce(move < limit, F.lit(False)))
    return ok.withColumns({c: F.when(F.col("ok_"), F.col(c)) for c in columns}).drop("ok_")


def long(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """One row for each factor: keep columns, factor, value."""
    return df.unpivot(keep, factors, "factor", "value")




def _corr(x: str, y: str) -> Column:
    """corr() of complete pairs that is null, not an error, without variance."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def ic_series(pairs: DataFrame, method: str = "spearman", least: int = 5) -> DataFrame:
    """factor, date, ic of rows factor, date, value, r: correlation by date over complete pairs, dates with fewer than `least` left out."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}")
    full = pairs.where("value IS NOT NULL AND r IS NOT NULL").select("factor", "date", "value", "r")
    if method == "spearman":
        day = Window.partitionBy("factor", "date")
        ties = lambda c: (F.count(F.lit(1)).over(Window.partitionBy("factor", "date", c)) - 1) / 2.0
        full = full.select("factor", "date", (F.rank().over(day.orderBy("value")) + ties("value")).alias("value"), (F.rank().over(day.orderBy("r")) + ties("r")).alias("r"))
    varied = (F.stddev_pop("value") > 1e-12) & (F.stddev_pop("r") > 1e-12)
    return full.groupBy("factor", "date").agg(F.when(varied, F.round(_corr("value", "r"), 12)).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n").where("ic IS NOT NULL")


def factor_returns(pairs: DataFrame, least: int = 10) -> DataFrame:
    """factor, date, fr: slope of r on the value z-scored by date, over dates with at least `least` values.

    The score uses all values of a date (population deviation) and r is centred on all its
    returns, while the sum runs over complete pairs and is divided by their number less one.
    """
    day = Window.partitionBy("factor", "date")
    z = (F.col("value") - F.avg("value").over(day)) / F.nullif(F.stddev_pop("value").over(day), F.lit(0.0))
    scored = pairs.select("factor", "date", z.alias("z"), (F.col("r") - F.avg("r").over(day)).alias("c"))
    told = scored.where("z IS NOT NULL AND c IS NOT NULL").groupBy("factor", "date").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("c")).alias("s"))
    return told.where(F.col("n") >= least).select("factor", "date", (F.col("s") / (F.col("n") - 1)).alias("fr"))


def rolling_factor_returns(pairs: DataFrame, least: int = 20) -> DataFrame:
    """factor_returns on the dates on which every factor has at least `least` complete pairs."""
    k = pairs.select("factor").distinct().count()
    told = factor_returns(pairs, least)
    whole = told.groupBy("date").agg(F.count("*").alias("k")).where(F.col("k") == k).select("date")
    return told.join(whole, "date", "left_semi")


def rolling_means(returns: DataFrame, window: int = 60) -> DataFrame:
    """Adds fr_mean, the mean of the last `window` factor returns up to the date."""
    return returns.withColumn("fr_mean", F.coalesce(F.avg("fr").over(_ahead("factor").rowsBetween(-(window - 1), 0)), F.lit(0.0)))


def _summary(ics: DataFrame, by: list[str]) -> DataFrame:
    return ics.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_pos_ratio"), F.count("*").alias("n_ic"))


def summarise(ics: DataFrame, returns: DataFrame, period: int = 1) -> DataFrame:
    """factor and the ten measures: ic_mean, ic_std, ic_ir, ic_pos_ratio, fr_mean, fr_std, fr_ir, fr_annual, t_stat, n_periods (dates with a factor return)."""
    fr = returns.groupBy("factor").agg(F.avg("fr").alias("fr_mean"), F.stddev_samp("fr").alias("fr_std"), F.count("*").alias("n_periods"))
    told = _summary(ics, ["factor"]).drop("n_ic").join(fr, "factor", "full")
    none = lambda c: F.when(F.col(c) > 0, F.col(c))
    return told.select(
        "factor", "ic_mean", "ic_std", (F.col("ic_mean") / none("ic_std")).alias("ic_ir"), "ic_pos_ratio", "fr_mean", "fr_std", (F.col("fr_mean") / none("fr_std")).alias("fr_ir"),
        (F.col("fr_mean") * YEAR / period).alias("fr_annual"), (F.col("ic_mean") / (none("ic_std") / F.sqrt(none("n_periods")))).alias("t_stat"), F.coalesce("n_periods", F.lit(0)).alias("n_periods"))


def evaluate(bars: DataFrame, factors: list[str], period: int = 1, method: str = "spearman", limit: float | None = 0.095, neutral: bool = True, industry: str = "industry", cap: str = "cap") -> DataFrame:
    """The measures of each factor column against the forward return, both sides without limit moves and neutralised if wanted."""
    held = forward_returns(bars, period)
    if limit is not None:
        move = F.abs(F.col("close") / F.nullif(F.lag("close").over(_ahead()), F.lit(0.0)) - 1)
        ok = held.withColumn("ok_", F.coalesce(move < limit, F.lit(False)))
        ok = ok.withColumn("ok_ahead", F.coalesce(F.lead("ok_", period).over(_ahead()), F.lit(False)))
        held = ok.withColumns({**{c: F.when(F.col("ok_"), F.col(c)) for c in factors}, "r": F.when(F.col("ok_ahead"), F.col("r"))}).drop("ok_", "ok_ahead")
    if neutral:
        held = neutralise(held, [*factors, "r"], industry, cap)
    pairs = long(held, factors, ["date", "code", "r"])
    return summarise(ic_series(pairs, method, 2), factor_returns(pairs), period)


def evaluate_horizons(bars: DataFrame, factors: list[str], periods: tuple[int, ...] = (1, 2, 3, 4, 5), **how) -> DataFrame:
    """evaluate for each horizon, with its column period."""
    return reduce(DataFrame.unionByName, [evaluate(bars, factors, p, **how).withColumn("period", F.lit(p)) for p in periods])


def evaluate_system(bars: DataFrame, factors: list[str], period: int = 1, **how) -> DataFrame:
    """All factors without limit filter, with coverage, by absolute ic_mean."""
    told = evaluate(bars, factors, period, limit=None, **how)
    return told.join(coverage(bars, factors), "factor", "left").orderBy(F.desc(F.abs("ic_mean")), "factor")


def coverage(bars: DataFrame, factors: list[str]) -> DataFrame:
    """factor, coverage: the share of dates with any value."""
    days = bars.groupBy("date").agg(*[F.max(F.col(c).isNotNull().cast("double")).alias(c) for c in factors])
    return long(days.agg(*[F.avg(c).alias(c) for c in factors]), factors, []).withColumnRenamed("value", "coverage")


def coverage_report(bars: DataFrame, factors: list[str], low: float = 0.3) -> DataFrame:
    """One row: min, median and max coverage, and the factors below `low`, lowest first."""
    told = coverage(bars, factors)
    few = F.transform(F.sort_array(F.collect_list(F.when(F.col("coverage") < low, F.struct("coverage", "factor")))), lambda x: x["factor"])
    return told.agg(F.min("coverage").alias("min_coverage"), F.expr("percentile(coverage, 0.5)").alias("median_coverage"), F.max("coverage").alias("max_coverage"), few.alias("low_coverage_factors"))


def cell_coverage(bars: DataFrame, factors: list[str], least: float = 0.3) -> DataFrame:
    """factor, coverage: the share of cells with a value, of at least `least`."""
    told = long(bars.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in factors]), factors, []).withColumnRenamed("value", "coverage")
    return told.where(F.col("coverage") >= least)


def correlation(returns: DataFrame) -> DataFrame:
    """a, b, corr: correlation of the factor returns of each pair over the dates that both have."""
    a, b = returns.select("date", F.col("factor").alias("a"), F.col("fr").alias("x")), returns.select("date", F.col("factor").alias("b"), F.col("fr").alias("y"))
    return a.join(b, "date").groupBy("a", "b").agg(_corr("x", "y").alias("corr"))


def redundant_pairs(pairs: DataFrame, above: float = 0.7) -> DataFrame:
    """a < b of correlation() with an absolute value above the limit."""
    return pairs.where((F.col("a") < F.col("b")) & (F.abs("corr") > above))


def effective(told: DataFrame, least_ir: float = 0.5, least_t: float = 2.0) -> DataFrame:
    return told.where((F.abs("ic_ir") > least_ir) & (F.abs("t_stat") > least_t))


def independent(told: DataFrame, pairs: DataFrame, above: float = 0.7, most_factors: int = 10_000) -> list[str]:
    """Factors by falling absolute ic_ir, each kept if it correlates with none kept before. A walk over a row a factor, on the driver, refused beyond `most_factors`."""
    names = [r["factor"] for r in told.orderBy(F.desc(F.abs("ic_ir")), "factor").select("factor").limit(most_factors + 1).collect()]
    if len(names) > most_factors:
        raise ValueError("too many factors for one walk")
    close = {(r["a"], r["b"]) for r in redundant_pairs(pairs, above).select("a", "b").collect()}
    kept: list[str] = []
    for name in names:
        if not any((name, k) in close or (k, name) in close for k in kept):
            kept.append(name)
    return kept


def top_factors(told: DataFrame, k: int = 20) -> DataFrame:
    return told.orderBy(F.desc(F.abs("ic_mean")), "factor").limit(k)


def aligned(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """Long factor rows with the sign of the value turned where ic_mean is negative."""
    signs = told.select("factor", F.when(F.col("ic_mean") < 0, -1.0).otherwise(1.0).alias("sign_"))
    return pairs.join(F.broadcast(signs), "factor").withColumn("value", F.col("value") * F.col("sign_")).drop("sign_")


def ic_decay(horizons: DataFrame, periods: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """factor, one column ic_mean a horizon, and the horizon of the largest absolute value."""
    wide = horizons.groupBy("factor").pivot("period", list(periods)).agg(F.first("ic_mean"))
    peak = horizons.groupBy("factor").agg(F.max_by("period", F.abs("ic_mean")).alias("peak"))
    return wide.select("factor", *[F.col(str(p)).alias(f"ic_{p}") for p in periods]).join(peak, "factor")


def zscores(df: DataFrame, columns: list[str], by: str = "date") -> DataFrame:
    """The columns less their mean over their sample deviation, by date or by code; no deviation gives null."""
    w = Window.partitionBy(by)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)) for c in columns})


def _guarded(df: DataFrame, columns: list[str], total: Column, out: str) -> DataFrame:
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.withColumn(out, F.when(known >= max(len(columns) // 2, 1), total))


def combine_equal(df: DataFrame, columns: list[str], out: str = "combined") -> DataFrame:
    """Mean of the known z-scores; null if fewer than half the factors are known."""
    z = zscores(df, columns)
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return _guarded(z, columns, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(known.cast("double"), F.lit(0.0)), out)


def combine_weighted(df: DataFrame, weights: dict[str, float], out: str = "combined") -> DataFrame:
    """Sum of weight / sum of absolute weights times the z-score, unknown ones as 0; without any weight the plain mean."""
    total = sum(abs(w) for w in weights.values())
    if not total:
        return combine_equal(df, list(weights), out)
    z = zscores(df, list(weights))
    return z.withColumn(out, sum((F.coalesce(c, F.lit(0.0)) * (w / total) for c, w in weights.items()), F.lit(0.0)))


def combine_icir(df: DataFrame, icir: dict[str, float], out: str = "combined") -> DataFrame:
    """combine_weighted by the absolute information ratio, null if fewer than half the factors are known."""
    told = combine_weighted(df, {c: abs(w) for c, w in icir.items()}, out)
    return _guarded(told, list(icir), F.col(out), out)


def combine_rank(df: DataFrame, columns: list[str], out: str = "combined") -> DataFrame:
    """Mean of the known rank shares by date, with the guard of combine_equal."""
    share = lambda c: F.when(F.col(c).isNotNull(), (F.rank().over(_day().orderBy(F.col(c).asc_nulls_last())) + (F.count(c).over(Window.partitionBy("date", c)) - 1) / 2.0) / F.count(c).over(_day()))
    ranked = df.withColumns({c: share(c) for c in columns})
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return _guarded(ranked, columns, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(known.cast("double"), F.lit(0.0)), out)


def model_power(df: DataFrame, weights: dict[str, float], method: str = "spearman") -> DataFrame:
    """One row: the IC measures of the weighted sum of factors z-scored by code over time. df has r; an unknown factor makes the sum unknown."""
    used = {c: w for c, w in weights.items() if w}
    w = Window.partitionBy("code")
    z = df.withColumn("value", sum(((F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + 1e-10) * x for c, x in used.items()), F.lit(0.0)))
    told = _summary(ic_series(z.withColumn("factor", F.lit("model")), method, 2), ["factor"])
    std = F.when(F.col("ic_std") > 0, F.col("ic_std"))
    return told.select("ic_mean", "ic_std", (F.col("ic_mean") / std).alias("ic_ir"), "ic_pos_ratio", (F.col("ic_mean") / (std / F.sqrt("n_ic"))).alias("t_stat"), F.col("n_ic").alias("n_periods"))


def factor_count(df: DataFrame, fr_ir: dict[str, float], method: str = "spearman") -> DataFrame:
    """n_factors, added_factor and the IC measures of the mean of the first n factors by falling absolute fr_ir, z-scored by code."""
    order = sorted(fr_ir, key=lambda c: (-abs(fr_ir[c] or 0), c))
    w = Window.partitionBy("code")
    z = df.select("date", "code", "r", *[((F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + 1e-10)).alias(c) for c in order])
    sums = z.select("date", "code", "r", *[(sum((F.col(c) for c in order[: k + 1]), F.lit(0.0)) / (k + 1)).alias(f"{k + 1}") for k in range(len(order))])
    told = _summary(ic_series(long(sums, [str(k + 1) for k in range(len(order))], ["date", "code", "r"]), method, 2), ["factor"])
    std = F.when(F.col("ic_std") > 0, F.col("ic_std"))
    names = F.array(*[F.lit(c) for c in order])
    return told.select(F.col("factor").cast("int").alias("n_factors"), F.get(names, F.col("factor").cast("int") - 1).alias("added_factor"), "ic_mean", "ic_std", (F.col("ic_mean") / std).alias("ic_ir"), (F.col("ic_mean") / (std / F.sqrt("n_ic"))).alias("t_stat")).orderBy("n_factors")


def quantile_returns(df: DataFrame, factor: str, groups: int = 5) -> DataFrame:
    """date, bucket, mean_return, n: groups between the quantiles of a date (linear, closed on the right), equal edges counted once."""
    full = df.where(F.col(factor).isNotNull() & F.col("r").isNotNull()).select("date", F.col(factor).alias("f"), "r")
    edges = full.groupBy("date").agg(F.expr(f"percentile(f, array({', '.join(repr(k / groups) for k in range(groups + 1))}))").alias("e")).withColumn("e", F.array_distinct("e"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    placed = full.join(edges, "date").withColumn("bucket", 1 + F.size(F.filter(inner, lambda x: F.col("f") > x)))
    return placed.groupBy("date", "bucket").agg(F.avg("r").alias("mean_return"), F.count("*").alias("n"))


def residuals(y: np.ndarray, industry: np.ndarray, size: np.ndarray | None, styles: np.ndarray | None = None, least: int = 20) -> np.ndarray:
    """What is left of each column of y after industries, z-scored log size and styles; columns of fewer than `least` complete rows come back as they are."""
    parts = [np.ones((len(y), 1))]
    names = sorted({x for x in industry if x is not None and x == x})
    parts += [(industry == x).astype(float)[:, None] for x in names[1:]]
    extra = [] if size is None else [np.log(np.where(size > 0, size, np.nan))[:, None]]
    extra += [] if styles is None else [styles]
    for block in extra:
        with np.errstate(all="ignore"):
            dev = np.nanstd(block, axis=0)
            parts.append(np.where(dev > 0, (block - np.nanmean(block, axis=0)) / np.where(dev > 0, dev, 1), 0.0))
    x = np.concatenate(parts, axis=1)
    known = ~np.isnan(x).any(axis=1) & np.array([v is not None and v == v for v in industry])
    out = y.copy()
    for k in range(y.shape[1]):
        ok = known & ~np.isnan(y[:, k])
        if ok.sum() >= least:
            beta, *_ = np.linalg.lstsq(x[ok], y[ok, k], rcond=None)
            out[:, k] = np.nan
            out[ok, k] = y[ok, k] - x[ok] @ beta
    return out


def neutralise(df: DataFrame, columns: list[str], industry: str = "industry", cap: str | None = "cap", styles: tuple[str, ...] = (), least: int = 20) -> DataFrame:
    """df with each column replaced by its residual by date; the other columns stay. One cross-section is one group."""
    keys = df.columns
    sent = df.select("date", "code", *[F.col(c).cast("double").alias(c) for c in columns], F.col(industry).cast("string").alias("industry_"), *([F.col(cap).cast("double").alias("cap_")] if cap else []), *[F.col(s).cast("double").alias(f"style_{s}") for s in styles])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        y = p[columns].to_numpy(float)
        out = residuals(y, p["industry_"].to_numpy(object), p["cap_"].to_numpy(float) if cap else None, p[[f"style_{s}" for s in styles]].to_numpy(float) if styles else None, least)
        return p[["date", "code"]].assign(**{c: out[:, k] for k, c in enumerate(columns)})

    done = sent.groupBy("date").applyInPandas(fit, f"date {kinds['date']}, code {kinds['code']}, " + ", ".join(f"{c} double" for c in columns))
    done = done.select("date", "code", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    return df.drop(*columns).join(done, ["date", "code"], "left").select(*keys)


def weights(n: int, halflife: float) -> np.ndarray:
    """0.5 ** (age / halflife), newest last, with sum 1."""
    w = 0.5 ** (np.arange(n)[::-1] / halflife)
    return w / w.sum()


def weighted_mean(x: np.ndarray, n: int, halflife: float) -> np.ndarray:
    """Of the last n values; fewer, or an unknown one among them, give NaN."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n) @ weights(n, halflife)
    return out


def weighted_std(x: np.ndarray, n: int, halflife: float) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        view, w = np.lib.stride_tricks.sliding_window_view(x, n), weights(n, halflife)
        out[n - 1 :] = np.sqrt(np.maximum(((view - (view @ w)[:, None]) ** 2) @ w, 0))
    return out


def weighted_beta(x: np.ndarray, bench: np.ndarray, n: int, halflife: float, least: int = 30) -> np.ndarray:
    """Slope on the benchmark in the last n rows; unknown pairs are left out and the weights made to sum to 1 again."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    a, b = np.lib.stride_tricks.sliding_window_view(x, n), np.lib.stride_tricks.sliding_window_view(bench, n)
    ok = ~(np.isnan(a) | np.isnan(b))
    w = weights(n, halflife) * ok
    with np.errstate(all="ignore"):
        w = w / w.sum(axis=1, keepdims=True)
        a, b = np.where(ok, a, 0), np.where(ok, b, 0)
        da, db = a - (a * w).sum(axis=1, keepdims=True), b - (b * w).sum(axis=1, keepdims=True)
        var = (w * db * db).sum(axis=1)
        slope = (w * da * db).sum(axis=1) / np.where(var > 1e-20, var, np.nan)
    out[n - 1 :] = np.where(ok.sum(axis=1) >= least, slope, np.nan)
    return out


def style_factors(bars: DataFrame, price: str = "close", bench: str = "bm_close", window: int = 252, vol_half: float = 40, beta_half: float = 60, far: int = 504, lag: int = 21, mom_half: float = 120) -> DataFrame:
    """date, code, beta, volatility, momentum; gaps take the last known value, then the next one (which looks ahead).

    One group is the history of a code, as long as the calendar.
    """
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date")
        close = p["price_"].astype(float)
        step, market = close.pct_change(fill_method=None).to_numpy(), p["bench_"].astype(float).pct_change(fill_method=None).to_numpy()
        told = pd.DataFrame({"date": p["date"], "code": p["code"], "beta": weighted_beta(step, market, window, beta_half), "volatility": weighted_std(step, window, vol_half) * np.sqrt(YEAR)})
        told["momentum"] = pd.Series(weighted_mean(np.log1p(step), far - lag, mom_half) * (far - lag), index=p.index).shift(lag)
        return told

    done = bars.select("date", "code", F.col(price).alias("price_"), F.col(bench).alias("bench_")).groupBy("code").applyInPandas(fit, f"date {kinds['date']}, code {kinds['code']}, beta double, volatility double, momentum double")
    since, onward = _ahead().rowsBetween(Window.unboundedPreceding, 0), _ahead().rowsBetween(0, Window.unboundedFollowing)
    filled = lambda c: F.coalesce(F.last(F.nanvl(c, F.lit(None).cast("double")), ignorenulls=True).over(since), F.first(F.nanvl(c, F.lit(None).cast("double")), ignorenulls=True).over(onward)).alias(c)
    return done.select("date", "code", *[filled(c) for c in ("beta", "volatility", "momentum")])


def regression_residuals(df: DataFrame, y: str, xs: list[str], window: int, out: str = "residual") -> DataFrame:
    """Adds the last residual of the regression with intercept of y on xs over the last `window` rows of each code; needs max(3, k + 1) complete rows. One group is one history."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date")
        a, b = p["y_"].to_numpy(float), np.column_stack([np.ones(len(p)), *[p[f"x{k}_"].to_numpy(float) for k in range(len(xs))]])
        got = np.full(len(p), np.nan)
        for t in range(len(p)):
            lo = max(0, t + 1 - window)
            ok = ~np.isnan(a[lo : t + 1]) & ~np.isnan(b[lo : t + 1]).any(axis=1)
            if ok[-1] and ok.sum() >= max(3, len(xs) + 1):
                beta, *_ = np.linalg.lstsq(b[lo : t + 1][ok], a[lo : t + 1][ok], rcond=None)
                got[t] = a[t] - b[t] @ beta
        return pd.DataFrame({"date": p["date"], "code": p["code"], out: got})

    sent = df.select("date", "code", F.col(y).cast("double").alias("y_"), *[F.col(x).cast("double").alias(f"x{k}_") for k, x in enumerate(xs)])
    done = sent.groupBy("code").applyInPandas(fit, f"date {kinds['date']}, code {kinds['code']}, {out} double")
    return df.join(done.withColumn(out, F.when(~F.isnan(out), F.col(out))), ["date", "code"], "left")
