"""Tables with keys in a folder of Parquet: append what is new, upsert, truncate, query.

A write makes a new numbered version of the table; readers take the newest finished one
(with _SUCCESS), so a lost executor or driver leaves the old version whole. Versions
before the last two are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns and key of each table.
TABLES = {
    "daily_bars": ("code string, date date, open double, high double, low double, close double, pre_close double, volume double, amount double, vwap double, turnover double, pct_change double, adj_factor double", ["code", "date"]),
    "index_daily": ("code string, date date, open double, high double, low double, close double, volume double, amount double", ["code", "date"]),
    "stock_info": ("code string, name string, industry string, market string, list_date date, out_date date, status int, market_cap double, data_start date, data_end date", ["code"]),
    "financials": ("code string, report_date date, publish_date date, eps double, bps double, roe double, revenue double, net_profit double", ["code", "report_date"]),
}


class Store:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, list[str]]] | None = None):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), dict(tables or TABLES)

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self, table: str) -> list[int]:
        fs, where = self._fs(f"{self.folder}/{table}")
        if not fs.exists(where):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{self.folder}/{table}/{n}/_SUCCESS")[1]))

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def read(self, table: str) -> DataFrame:
        """The newest version, with columns it does not have yet as nulls."""
        if not self.exists(table):
            return self.spark.createDataFrame([], self.tables[table][0])
        return self._conform(self.spark.read.parquet(f"{self.folder}/{table}/v{self._versions(table)[-1]}"), table)

    def _schema(self, table: str):
        return self.spark.createDataFrame([], self.tables[table][0]).schema

    def _conform(self, df: DataFrame, table: str) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(table).fields])

    def _write(self, df: DataFrame, table: str) -> None:
        last = self._versions(table)
        fs, _ = self._fs(self.folder)
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/v{(last[-1] if last else 0) + 1}")
        for old in last[:-1]:
            fs.delete(self._fs(f"{self.folder}/{table}/v{old}")[1], True)

    def _first(self, df: DataFrame, table: str) -> DataFrame:
        """The first row of each key of a batch, in its order."""
        placed = df.withColumn("n_", F.monotonically_increasing_id())
        keys = self.tables[table][1]
        return placed.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy("n_"))).where("k_ = 1").drop("n_", "k_")

    def insert_or_ignore(self, df: DataFrame, table: str) -> int:
        """Adds the rows whose key is new; returns their number."""
        keys, now = self.tables[table][1], self.read(table)
        new = self._conform(self._first(df, table), table).join(now.select(*keys), keys, "left_anti").select(*now.columns)
        before = now.count()
        self._write(now.unionByName(new), table)
        return self.read(table).count() - before

    def upsert(self, df: DataFrame, table: str) -> int:
        """Rows replace those of their key, columns that the batch has not keep their value; returns the rows given."""
        keys, now = self.tables[table][1], self.read(table)
        batch = self._first(df, table)
        given = [c for c in now.columns if c in batch.columns and c not in keys]
        old = now.select(*keys, *[F.col(c).alias(f"old_{c}") for c in now.columns if c not in keys], F.lit(True).alias("was_"))
        new = batch.select(*keys, *given, F.lit(True).alias("is_"))
        both = new.join(old, keys, "full")
        self._write(self._conform(both.select(*keys, *[(F.when(F.col("is_"), F.col(c)).otherwise(F.col(f"old_{c}")) if c in given else F.col(f"old_{c}")).alias(c) for c in now.columns if c not in keys]), table), table)
        return df.count()

    def truncate(self, table: str) -> None:
        self._write(self.spark.createDataFrame([], self.tables[table][0]), table)

    def query(self, sql: str, args: list | None = None) -> DataFrame:
        """SQL over the tables by name, with ? for arguments."""
        for table in self.tables:
            self.read(table).createOrReplaceTempView(table)
        return self.spark.sql(sql, args=args or [])

    def latest_date(self, table: str, code: str):
        return self.read(table).where(F.col("code") == code).agg(F.max("date")).first()[0]

    def refresh_ranges(self) -> int:
        """Writes the first and last date of the bars of each code to stock_info; returns the codes with bars."""
        spans = self.read("daily_bars").groupBy("code").agg(F.min("date").alias("data_start"), F.max("date").alias("data_end"))
        return self.upsert(spans, "stock_info")

    def date_ranges(self) -> DataFrame:
        return self.read("stock_info").where("data_start IS NOT NULL").select("code", "data_start", "data_end")

    def backfill(self) -> None:
        """vwap, adj_factor and pre_close of stored bars where they are null."""
        before = F.last("close", ignorenulls=True).over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
        bars = self.read("daily_bars").withColumns({
            "vwap": F.coalesce("vwap", F.col("amount") / F.nullif("volume", F.lit(0.0))), "adj_factor": F.coalesce("adj_factor", F.lit(1.0)),
            "pre_close": F.coalesce("pre_close", F.col("close") / F.nullif(1 + F.col("pct_change") / 100, F.lit(0.0)), before)})
        self._write(bars, "daily_bars")

    def daily(self, codes: list[str] | None = None, start=None, end=None, adjust: str = "none") -> DataFrame:
        """Bars of the codes between the dates, by code and date, adjusted if wanted; one scan with pushed filters."""
        from barloom.operators.cleaning import adjust as adjusted

        out = self.read("daily_bars")
        for ok, test in ((codes, lambda: F.col("code").isin(codes)), (start, lambda: F.col("date") >= F.lit(start)), (end, lambda: F.col("date") <= F.lit(end))):
            if ok is not None:
                out = out.where(test())
        return adjusted(out, adjust).orderBy("code", "date")

    def index_daily(self, code: str = "000300", start=None, end=None) -> DataFrame:
        out = self.read("index_daily").where(F.col("code") == code)
        out = out if start is None else out.where(F.col("date") >= F.lit(start))
        return (out if end is None else out.where(F.col("date") <= F.lit(end))).orderBy("date")

    def financials(self, codes: list[str] | None = None, start=None, end=None, fields: list[str] | None = None) -> DataFrame:
        out = self.read("financials")
        out = out if codes is None else out.where(F.col("code").isin(codes))
        out = out if start is None else out.where(F.col("report_date") >= F.lit(start))
        out = out if end is None else out.where(F.col("report_date") <= F.lit(end))
        return out.select(*dict.fromkeys(["code", "report_date", *(fields or out.columns)])).orderBy("code", "report_date")

    def trade_dates(self, start=None, end=None) -> DataFrame:
        out = self.read("daily_bars").select("date").distinct()
        out = out if start is None else out.where(F.col("date") >= F.lit(start))
        return (out if end is None else out.where(F.col("date") <= F.lit(end))).orderBy("date")

    def stock_info(self, codes: list[str] | None = None) -> DataFrame:
        out = self.read("stock_info")
        return out if codes is None else out.where(F.col("code").isin(codes))


def missing_spans(codes: DataFrame, ranges: DataFrame, start, end) -> DataFrame:
    """code, from_date, to_date: what each code still lacks; those with bars go on from the day after their last, the up to date are left out."""
    told = codes.select("code").distinct().join(ranges, "code", "left")
    begin = F.coalesce(F.date_add("data_end", 1), F.lit(start).cast("date"))
    return told.select("code", begin.alias("from_date"), F.lit(end).cast("date").alias("to_date")).where("from_date <= to_date")


def asof_factors(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars with adj_factor of the last event (code, date, factor) up to the date; 1 before the first."""
    both = bars.withColumn("factor", F.lit(None).cast("double")).withColumn("bar_", F.lit(True)).unionByName(events.select("code", "date", F.col("factor").cast("double")).withColumn("bar_", F.lit(False)), allowMissingColumns=True)
    # the events of a date come before its bar
    since = Window.partitionBy("code").orderBy("date", "bar_").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("adj_factor", F.coalesce(F.last("factor", ignorenulls=True).over(since), F.lit(1.0))).where("bar_").drop("factor", "bar_")
