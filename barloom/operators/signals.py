"""Recorded provider payloads to typed rows: each parser is a select over a column of text.

Frames have a column payload (the body as text; decode bytes first with F.decode) and
any other columns, which stay. A payload that cannot be read gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Place of each field in the quote line.
QUOTE = {"price": 3, "last_close": 4, "open": 5, "change_amt": 31, "change_pct": 32, "high": 33, "low": 34, "amount_wan": 37, "turnover_pct": 38, "pe_ttm": 39, "amplitude_pct": 43, "mcap_yi": 44, "float_mcap_yi": 45, "pb": 46, "limit_up": 47, "limit_down": 48, "vol_ratio": 49, "pe_static": 52}
#: Report, date field, and other output columns with their source field and default.
REPORTS = {
    "block_trade": ("TRADE_DATE", {"price": ("DEAL_PRICE", 0.0), "close": ("CLOSE_PRICE", 0.0), "vol": ("DEAL_VOLUME", 0.0), "amount": ("DEAL_AMT", 0.0), "buyer": ("BUYER_NAME", ""), "seller": ("SELLER_NAME", "")}),
    "dividend": ("EX_DIVIDEND_DATE", {"bonus_rmb": ("PRETAX_BONUS_RMB", 0.0), "transfer_ratio": ("TRANSFER_RATIO", 0.0), "bonus_ratio": ("BONUS_RATIO", 0.0), "plan": ("ASSIGN_PROGRESS", "")}),
    "margin": ("DATE", {c.lower(): (c, 0.0) for c in ("RZYE", "RZMRE", "RZCHE", "RQYE", "RQMCL", "RQCHL", "RZRQYE")}),
    "holders": ("END_DATE", {"holder_num": ("HOLDER_NUM", 0.0), "change_num": ("HOLDER_NUM_CHANGE", 0.0), "change_ratio": ("HOLDER_NUM_RATIO", 0.0), "avg_shares": ("AVG_FREE_SHARES", 0.0)}),
    "lockup": ("FREE_DATE", {"type": ("LIMITED_STOCK_TYPE", ""), "shares": ("FREE_SHARES_NUM", 0.0), "ratio": ("FREE_RATIO", 0.0)}),
}
#: Fields of a row of the limit pools.
_POOL = "array<struct<c:string,n:string,p:double,zdp:double,amount:double,ltsz:double,hs:double,lbc:int,fbt:bigint,lbt:bigint,fund:double,zbc:int,hybk:string,zttj:struct<days:int,ct:int>>>"


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "payload"]


def _number(x: Column, default: float | None = 0.0) -> Column:
    got = x.try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def quotes(df: DataFrame) -> DataFrame:
    """code, name and the numbers of QUOTE of lines v_xx000000="...~..."; lines of fewer than 53 fields are left out, empty fields are 0."""
    lines = df.select(*_others(df), F.explode(F.split("payload", ";")).alias("line_")).where(F.col("line_").contains("=") & F.col("line_").contains('"'))
    parts = lines.select(*_others(df), F.regexp_extract("line_", r"_[a-z]{2}([^=_]*)=", 1).alias("code"), F.split(F.get(F.split("line_", '"'), 1), "~").alias("v_")).where(F.size("v_") >= 53)
    return parts.select(*_others(df), "code", F.get("v_", 1).alias("name"), *[_number(F.get("v_", k)).alias(c) for c, k in QUOTE.items()])


def quoted_fields(payload: str | Column = "payload") -> Column:
    """The comma-separated fields between the first two quotes; none if there are no quotes."""
    text = F.col(payload) if isinstance(payload, str) else payload
    return F.when(text.contains('"'), F.split(F.get(F.split(text, '"'), 1), ",")).otherwise(F.expr("cast(array() as array<string>)"))


def number_or_text(x: Column) -> Column:
    """struct(number, text): the number if it is one, else the text."""
    got = x.try_cast("double")
    return F.struct(got.alias("number"), F.when(got.isNull(), x).alias("text"))


def fund_flow(df: DataFrame, minute: bool = False) -> DataFrame:
    """date (or time), main_net, small_net, mid_net, large_net, super_net of the lines of data.klines; '-' is 0; short lines are left out."""
    lines = df.select(*_others(df), F.explode(F.from_json(F.get_json_object("payload", "$.data.klines"), "array<string>")).alias("l_")).select(*_others(df), F.split("l_", ",").alias("v_")).where(F.size("v_") >= (6 if minute else 7))
    names = ("main_net", "small_net", "mid_net", "large_net", "super_net")
    day = F.get("v_", 0).alias("time") if minute else F.get("v_", 0).try_cast("date").alias("date")
    return lines.select(*_others(df), day, *[_number(F.get("v_", k + 1)).alias(c) for k, c in enumerate(names)])


def report_rows(df: DataFrame, report: str) -> DataFrame:
    """Rows of result.data of one of REPORTS: date and its columns; an unknown number is 0. block_trade has premium_pct."""
    date, columns = REPORTS[report]
    items = df.select(*_others(df), F.explode(F.from_json(F.get_json_object("payload", "$.result.data"), "array<map<string,string>>")).alias("m_"))
    out = [F.coalesce(F.col("m_")[source], F.lit("")).alias(c) if isinstance(default, str) else _number(F.col("m_")[source], default).alias(c) for c, (source, default) in columns.items()]
    rows = items.select(*_others(df), F.substring(F.col("m_")[date], 1, 10).try_cast("date").alias("date"), *out)
    if report == "block_trade":
        rows = rows.withColumn("premium_pct", F.when(F.col("close") == 0, 0.0).otherwise(F.round((F.col("price") / F.nullif("close", F.lit(0.0)) - 1) * 100, 2)))
    return rows


def lockups(rows: DataFrame, day, ahead: int = 90, history: int = 15) -> DataFrame:
    """Of report_rows(lockup): kind 'history' (the latest up to `day`) and 'upcoming' (the next `ahead` days)."""
    past = rows.where(F.col("date") <= F.lit(day)).orderBy(F.desc("date")).limit(history).withColumn("kind", F.lit("history"))
    coming = rows.where((F.col("date") > F.lit(day)) & (F.col("date") <= F.date_add(F.lit(day), ahead))).withColumn("kind", F.lit("upcoming"))
    return past.unionByName(coming)


def pool_time(t: Column) -> Column:
    """92500 as 09:25:00."""
    return F.regexp_replace(F.lpad(t.cast("bigint").cast("string"), 6, "0"), r"(..)(..)(..)", "$1:$2:$3")


def limit_pool(df: DataFrame) -> DataFrame:
    """Rows of data.pool of a limit-up, broken, limit-down or yesterday's pool."""
    rows = df.select(*_others(df), F.explode(F.from_json(F.get_json_object("payload", "$.data.pool"), _POOL)).alias("p"))
    stat = F.concat(F.coalesce(F.col("p.zttj.days").cast("string"), F.lit("?")), F.lit("天"), F.coalesce(F.col("p.zttj.ct").cast("string"), F.lit("?")), F.lit("板"))
    return rows.select(
        *_others(df), F.col("p.c").alias("code"), F.col("p.n").alias("name"), (F.col("p.p") / 1000).alias("price"), F.round("p.zdp", 2).alias("pct"), F.col("p.amount").alias("amount"), F.col("p.ltsz").alias("float_cap"), F.round("p.hs", 2).alias("turnover"),
        F.col("p.lbc").alias("limit_days"), pool_time(F.col("p.fbt")).alias("first_seal"), pool_time(F.col("p.lbt")).alias("last_seal"), F.col("p.fund").alias("seal_fund"), F.col("p.zbc").alias("break_times"), F.coalesce("p.hybk", F.lit("")).alias("industry"), stat.alias("zt_stat"))


def sentiment(pools: DataFrame) -> DataFrame:
    """One row a date of rows (date, kind up/broken/down/yesterday, limit_days, pct): counts, break_rate, max_height, ladder (limit_days to count), promotion_rate."""
    n = lambda k: F.count_if(F.col("kind") == k)
    told = pools.groupBy("date").agg(
        n("up").alias("zt_count"), n("broken").alias("zb_count"), n("down").alias("dt_count"), n("yesterday").alias("y_"), F.count_if((F.col("kind") == "yesterday") & (F.col("pct") >= 9.8)).alias("p_"),
        F.coalesce(F.max(F.when(F.col("kind") == "up", F.col("limit_days"))), F.lit(0)).alias("max_height"))
    steps = pools.where("kind = 'up'").groupBy("date", "limit_days").agg(F.count(F.lit(1)).alias("n")).groupBy("date").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("limit_days", "n")))).alias("ladder"))
    share = lambda a, b: F.when(b > 0, F.round(100 * a / b, 1)).otherwise(0.0)
    return told.join(steps, "date", "left").select("date", "zt_count", "zb_count", "dt_count", share(F.col("zb_count"), F.col("zt_count") + F.col("zb_count")).alias("break_rate"), "max_height", F.coalesce("ladder", F.expr("cast(map() as map<int,bigint>)")).alias("ladder"), share(F.col("p_"), F.col("y_")).alias("promotion_rate"))


def dedup_articles(articles: DataFrame) -> DataFrame:
    """Of each uid (else title and date) the row of the highest score, the first of equal ones (by row order in column n, if there is one, else by all columns); newest first."""
    key = F.coalesce(F.nullif("uid", F.lit("")), F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("publish_date", F.lit(""))))
    order = ["n"] if "n" in articles.columns else articles.columns
    best = Window.partitionBy("key_").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), *order)
    return articles.withColumn("key_", key).withColumn("k_", F.row_number().over(best)).where("k_ = 1").drop("key_", "k_").orderBy(F.desc("publish_date"))


def northbound(df: DataFrame) -> DataFrame:
    """time, hgt, sgt: three arrays side by side, cut to the shortest."""
    arrays = df.select(*_others(df), F.from_json("payload", "time array<string>, hgt array<double>, sgt array<double>").alias("j")).select(*_others(df), "j.time", "j.hgt", "j.sgt")
    n = F.least(F.size("time"), F.size("hgt"), F.size("sgt"))
    return arrays.where(n > 0).select(*_others(df), F.inline(F.arrays_zip(*[F.slice(c, 1, n).alias(c) for c in ("time", "hgt", "sgt")])))


def daily_snapshot(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """stored (date, hgt, sgt) with the last known values of rows (date, time, hgt, sgt) for their dates."""
    last = rows.groupBy("date").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("time"))).alias(c) for c in ("hgt", "sgt")])
    return stored.join(last, "date", "left_anti").unionByName(last).orderBy("date")


def order_book(df: DataFrame, levels: int = 5) -> DataFrame:
    """Wide bid1, bid_vol1, ask_vol1 ... to level, price (that of the bid), bid_vol, ask_vol."""
    keep = [c for c in df.columns if not c.startswith(("bid", "ask"))]
    stack = ", ".join(f"{k}, bid{k}, bid_vol{k}, ask_vol{k}" for k in range(1, levels + 1))
    return df.select(*keep, F.expr(f"stack({levels}, {stack}) AS (level, price, bid_vol, ask_vol)"))


def announcements(df: DataFrame) -> DataFrame:
    rows = df.select(*_others(df), F.explode(F.from_json(F.get_json_object("payload", "$.announcements"), "array<struct<announcementTitle:string,announcementTypeName:string,announcementTime:bigint,adjunctUrl:string>>")).alias("a"))
    return rows.select(*_others(df), F.coalesce("a.announcementTitle", F.lit("")).alias("title"), F.coalesce("a.announcementTypeName", F.lit("")).alias("type"), epoch_date(F.col("a.announcementTime")).alias("date"), F.col("a.adjunctUrl").alias("url"))


def epoch_date(ms: Column, zone: str = "Asia/Shanghai") -> Column:
    """The date of milliseconds since 1970 in a time zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def industries(df: DataFrame) -> DataFrame:
    """rank, name, change_pct, code, up_count, down_count, leader, leader_change of data.diff, by falling change."""
    rows = df.select(*_others(df), F.explode(F.from_json(F.get_json_object("payload", "$.data.diff"), "array<map<string,string>>")).alias("m"))
    told = rows.select(*_others(df), F.coalesce(F.col("m")["f14"], F.lit("")).alias("name"), _number(F.col("m")["f3"]).alias("change_pct"), F.coalesce(F.col("m")["f12"], F.lit("")).alias("code"), _number(F.col("m")["f104"]).cast("int").alias("up_count"), _number(F.col("m")["f105"]).cast("int").alias("down_count"), F.coalesce(F.col("m")["f140"], F.lit("")).alias("leader"), _number(F.col("m")["f136"]).alias("leader_change"))
    return told.withColumn("rank", F.row_number().over(Window.partitionBy(*(_others(df) or [F.lit(0)])).orderBy(F.desc("change_pct"), "code")))


def plain_text(html: Column, most: int = 200) -> Column:
    """Text without tags, cut to so many characters."""
    return F.substring(F.regexp_replace(html, "<[^>]+>", ""), 1, most)


def unwrapped(jsonp: Column) -> Column:
    """The JSON inside callback(...)."""
    return F.regexp_extract(jsonp, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)


_INF = float("inf")


def forward_pe(price: Column, eps: Column) -> Column:
    return F.when(eps <= 0, _INF).otherwise(price / F.when(eps > 0, eps))


def pe_digestion(pe: Column, growth: Column, target: float = 30.0) -> Column:
    """Years until growth brings pe down to the target."""
    return F.when(pe <= target, 0.0).when(growth <= 0, _INF).otherwise(F.log(pe / target) / F.log(1 + F.when(growth > 0, growth)))


def peg(pe: Column, growth: Column) -> Column:
    return F.when(growth <= 0, _INF).otherwise(pe / (F.when(growth > 0, growth) * 100))


def valuation(quoted: DataFrame, eps: DataFrame) -> DataFrame:
    """Quotes with forward measures from eps (code, eps_cur, eps_next, analyst_count); null where there is no estimate."""
    both = quoted.select("code", "name", "price", "mcap_yi", "pe_ttm", "pb").join(eps, "code", "left")
    known = F.coalesce(F.col("eps_cur") != 0, F.lit(False))
    held = both.withColumn("pe_", F.when(known, forward_pe(F.col("price"), F.col("eps_cur"))).otherwise(_INF)).withColumn("g_", F.when(F.col("eps_cur") > 0, F.coalesce(F.col("eps_next") / F.col("eps_cur") - 1, F.lit(0.0))).otherwise(0.0))
    infinite = F.col("pe_") == _INF
    told = held.withColumn("peg_", F.when(infinite, _INF).otherwise(peg(F.col("pe_"), F.col("g_"))))
    years = F.when(infinite, _INF).otherwise(pe_digestion(F.col("pe_"), F.col("g_")))
    return told.select("code", "name", "price", "mcap_yi", "pe_ttm", "pb", "eps_cur", "eps_next", F.when(known, F.round("pe_", 1)).alias("pe_fwd"), F.when(F.col("g_") != 0, F.round(100 * F.col("g_"), 0)).alias("cagr_pct"), F.when(F.col("peg_") != _INF, F.round("peg_", 2)).alias("peg"), F.round(years, 1).alias("digest_years"), F.coalesce("analyst_count", F.lit(0)).alias("analyst_count"))
