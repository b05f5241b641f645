"""The plan of the weekly bars."""

from pyspark.sql import functions as F

from barloom.sources.bars import weekly_bars


def test_the_grid_is_not_broadcast(spark):
    """A filter on close makes the grid's join an inner one, whose left side Spark takes to be as small as its codes."""
    traded = weekly_bars(spark, "/root/testdata/sf0.001").where(F.col("close").isNotNull()).select("code", "date", "close")
    run = traded._jdf.queryExecution()
    run.toRdd().count()
    plan = run.executedPlan().toString()
    assert "SortMergeJoin" in plan and "BuildLeft" not in plan


def test_lines_are_dealt_once(spark, tmp_path):
    """Windows and aggregation share one exchange, which holds no price."""
    spark.sql("SELECT 1L AS l_suppkey, 1L AS l_orderkey, 1L AS l_partkey, 1 AS l_linenumber, 2.0D AS l_quantity, 3.0D AS l_extendedprice, TIMESTAMP '2020-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS s_suppkey, 1.0D AS s_acctbal, 1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    bars = weekly_bars(spark, str(tmp_path)).select("date", "code", "close")
    plan = bars._jdf.queryExecution().executedPlan().toString().split("\n")
    window = next(k for k, line in enumerate(plan) if "Window [row_number" in line)
    last, first = [k for k in range(window) if "HashAggregate(keys=[code" in plan[k]][-2:]
    assert not any("Exchange" in line for line in plan[last:window])
    dealt = next(k for k in range(window, len(plan)) if "Exchange" in plan[k])
    assert not any("/" in line for line in plan[dealt + 1 : dealt + 2])
    assert [r.close for r in bars.collect()] == [1.5]
