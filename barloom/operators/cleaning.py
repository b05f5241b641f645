"""Cleaning of daily bars: functions of frames and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "pre_close", "volume", "amount", "vwap", "turnover", "pct_change", "adj_factor")


def _since(by: str) -> Window:
    return Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def _onward(by: str) -> Window:
    return Window.partitionBy(by).orderBy("date").rowsBetween(0, Window.unboundedFollowing)


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")), x)


def standardise_columns(df: DataFrame) -> DataFrame:
    """date as a date and the known numeric columns as doubles; what cannot be read is null."""
    out = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in df.columns if c in NUMBERS}
    if "date" in df.columns:
        out["date"] = F.expr("try_cast(`date` AS DATE)")
    return df.withColumns(out) if out else df


def fill_missing(df: DataFrame, method: str = "ffill", columns: list[str] | None = None, by: str = "code") -> DataFrame:
    """Numeric columns filled by code: with the last known value, the next one, or linearly between both; what is left takes the next known, linear ends the last."""
    chosen = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != by]
    before = lambda c: F.last(_known(F.col(c)), ignorenulls=True).over(_since(by))
    after = lambda c: F.first(_known(F.col(c)), ignorenulls=True).over(_onward(by))
    if method == "ffill":
        return df.withColumns({c: F.coalesce(before(c), after(c)) for c in chosen})
    if method == "bfill":
        return df.withColumns({c: after(c) for c in chosen})
    if method != "interpolate":
        raise ValueError(f"unknown method {method!r}")
    placed = df.withColumn("n_", F.row_number().over(Window.partitionBy(by).orderBy("date")))
    at = lambda c, what, w: what(F.when(_known(F.col(c)).isNotNull(), F.col("n_")), ignorenulls=True).over(w)
    out = {}
    for c in chosen:
        lo, hi = at(c, F.last, _since(by)), at(c, F.first, _onward(by))
        share = (F.col("n_") - lo) / F.nullif((hi - lo).cast("double"), F.lit(0.0))
        out[c] = F.coalesce(_known(F.col(c)).cast("double"), before(c) + share * (after(c) - before(c)), before(c), after(c))
    return placed.withColumns(out).drop("n_")


def outliers(df: DataFrame, column: str = "pct_change", threshold: float = 0.11) -> DataFrame:
    """Rows beyond the threshold; a column with a value above 1 is taken as percent."""
    top = df.agg(F.max(column).alias("m")).scalar()
    return df.where(F.abs(column) > F.when(top > 1, threshold * 100).otherwise(threshold))


def remove_suspended(df: DataFrame) -> DataFrame:
    return df.where("volume > 0")


def drop_invalid(df: DataFrame, by: str = "code") -> DataFrame:
    """Without the codes that have any price that is null or not positive, or a volume or amount that is null or negative; without a code column, without such rows."""
    bad = F.lit(False)
    for c in df.columns:
        if c in PRICES:
            bad = bad | F.coalesce(F.col(c) <= 0, F.lit(True))
        elif c in ("volume", "amount"):
            bad = bad | F.coalesce(F.col(c) < 0, F.lit(True))
    if by not in df.columns:
        return df.where(~bad)
    return df.join(df.where(bad).select(by).distinct(), by, "left_anti").select(*df.columns)


def price_checks(df: DataFrame) -> DataFrame:
    """One row of counts: prices not positive, vwap outside 99 % of the low to 101 % of the high, pre_close more than 2 % off the close before."""
    before = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    held = df.withColumn("before_", before)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    has = lambda c: c in df.columns
    positive = [F.col(c) <= 0 for c in PRICES if has(c)]
    some = positive[0] if positive else F.lit(False)
    for c in positive[1:]:
        some = some | c
    outside = (F.col("vwap") < 0.99 * F.col("low")) | (F.col("vwap") > 1.01 * F.col("high")) if has("vwap") else F.lit(False)
    off = F.abs(F.col("pre_close") / F.nullif("before_", F.lit(0.0)) - 1) > 0.02 if has("pre_close") else F.lit(False)
    return held.agg(F.count(F.lit(1)).alias("n_rows"), count(some).alias("n_not_positive"), count(outside).alias("n_vwap_outside"), count(off).alias("n_pre_close_off"))


def missing_vwap(df: DataFrame) -> DataFrame:
    """vwap = amount / volume if the column is absent or empty."""
    own = F.col("amount") / F.nullif("volume", F.lit(0.0))
    if "vwap" not in df.columns:
        return df.withColumn("vwap", own)
    none = df.agg(F.count("vwap").alias("n")).scalar() == 0
    return df.withColumn("vwap", F.when(none, own).otherwise(F.col("vwap")))


def clean(df: DataFrame, fill: str = "ffill", suspended: bool = True) -> DataFrame:
    """drop_invalid, standardise_columns, missing_vwap, fill_missing, remove_suspended (if wanted)."""
    out = fill_missing(missing_vwap(standardise_columns(drop_invalid(df))), fill)
    return remove_suspended(out) if suspended else out


def standardise_daily(df: DataFrame, code: str | None = None, names: dict[str, str] | None = None, lots: bool = False) -> DataFrame:
    """date, code, prices, pre_close, volume in shares, amount, vwap, turnover, pct_change, adj_factor from a provider's columns; what is not given is derived or null."""
    out = df.withColumnsRenamed({k: v for k, v in (names or {}).items() if k in df.columns})
    if code is not None:
        out = out.withColumn("code", F.lit(code))
    out = standardise_columns(out)
    given = lambda c: c in out.columns
    if lots and given("volume"):
        out = out.withColumn("volume", F.col("volume") * 100)
    if not given("pre_close"):
        lagged = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
        out = out.withColumn("pre_close", F.col("close") / (1 + F.col("pct_change") / 100) if given("pct_change") else F.col("close") - F.col("change").cast("double") if given("change") else lagged)
    if not given("adj_factor"):
        out = out.withColumn("adj_factor", F.col("close") / F.nullif(F.expr("try_cast(close_raw AS DOUBLE)"), F.lit(0.0)) if given("close_raw") else F.lit(1.0))
    if not given("vwap"):
        out = out.withColumn("vwap", F.col("amount") / (F.nullif("volume", F.lit(0.0)) + 1e-10) if given("amount") and given("volume") else F.lit(None).cast("double"))
    wanted = ("date", "code", *NUMBERS)
    return out.select(*[F.col(c) if given(c) else F.lit(None).cast("double").alias(c) for c in wanted])


def adjust(df: DataFrame, method: str = "hfq") -> DataFrame:
    """Prices times adj_factor (hfq), or times its share of the code's largest (qfq), or as they are."""
    if method not in ("hfq", "qfq") or "adj_factor" not in df.columns:
        return df
    top = F.max("adj_factor").over(Window.partitionBy("code"))
    factor = F.col("adj_factor") if method == "hfq" else F.when(top > 0, F.col("adj_factor") / top).otherwise(F.col("adj_factor"))
    kept = df.withColumn("f_", factor)
    return kept.withColumns({c: F.col(c) * F.col("f_") for c in (*PRICES, "pre_close", "vwap") if c in df.columns}).drop("f_")
