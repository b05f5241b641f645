"""Weekly bars from line items: the panel on which factors run.

Code = supplier, date = Monday of the shipping week. Price = extended price /
quantity; open and close are the first and last line of the week in a full order
of the columns. Missing weeks of a code are rows with null values, so that a row
step is a week. vwap = amount / volume; ret = close / previous known close - 1; the
benchmark is the mean close and open of a week.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINES = """
WITH l AS (
  SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS extended,
         row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS first_place,
         row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS last_place
  FROM {lineitem}
"""
#: The same for Spark: weeks are the key of the windows as of the aggregation after them, so lines are dealt once, and prices are not dealt with them.
_SPARK_LINES = """
WITH s AS (
  SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM {lineitem}
), o AS (
  SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS first_place,
         row_number() OVER (PARTITION BY code, date ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS last_place
  FROM s
), l AS (
  SELECT code, date, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice AS extended, first_place, last_place FROM o
"""
#: Both engines read this text after their lines; {hint} is empty for DuckDB.
_BARS = """), b AS (
  SELECT code, date, max(CASE WHEN first_place = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN last_place = 1 THEN price END) AS close,
         CAST(sum(CAST(quantity AS DECIMAL(18, 2))) AS DOUBLE) AS volume, CAST(sum(CAST(extended AS DECIMAL(18, 2))) AS DOUBLE) AS amount
  FROM l GROUP BY code, date
), grid AS (
  SELECT code, {explode} AS date FROM (SELECT DISTINCT code FROM b) c
), d AS (
  SELECT {hint}grid.date, grid.code, open, high, low, close, volume, amount, amount / volume AS vwap, s_acctbal AS cap, s_nationkey AS industry
  FROM grid LEFT JOIN b ON b.code = grid.code AND b.date = grid.date LEFT JOIN {supplier} ON s_suppkey = grid.code
), m AS (
  SELECT date, avg(close) AS bm_close, avg(open) AS bm_open FROM b GROUP BY date
), p AS (
  SELECT d.*, bm_close, bm_open, {ffill} AS padded FROM d JOIN m ON m.date = d.date
)
SELECT date, code, open, high, low, close, volume, amount, vwap, cap, industry, bm_close, bm_open,
       padded / nullif(lag(padded) OVER (PARTITION BY code ORDER BY date), CAST(0 AS DOUBLE)) - 1 AS ret
FROM p
"""
DUCK_BARS = (_LINES + _BARS).format(hint="", lineitem="lineitem", supplier="supplier", explode="unnest((SELECT list(DISTINCT date) FROM b))", ffill="last_value(close IGNORE NULLS) OVER (PARTITION BY d.code ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel. The grid explodes one array of weeks for each code; weeks are as many as the calendar has.

    Spark takes the grid to be as small as its codes and would broadcast it where a filter makes
    the join an inner one, so the join is told to sort and merge.
    """
    sql = (_SPARK_LINES + _BARS).format(hint="/*+ MERGE(b) */ ", lineitem="{lineitem}", supplier="{supplier}", explode="explode((SELECT collect_set(date) FROM b))", ffill="last(close, true) OVER (PARTITION BY d.code ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return spark.sql(sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
