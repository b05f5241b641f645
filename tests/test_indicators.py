import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators
from barloom.sources.bars import weekly_bars


def test_families_and_registry(spark):
    bars = weekly_bars(spark, "/root/testdata/sf0.001").where("code <= 3")
    got = indicators.create("oscillator", bars)
    assert got.count() == bars.count() and {"rsi6", "k", "d", "j", "cci", "willr"} <= set(got.columns)
    one = indicators.one("ind_rsi", bars).where("rsi6 IS NOT NULL").count()
    assert got.where(F.col("rsi6").isNotNull()).count() == one
    indicators.register("range", lambda df: df.select("date", "code", (F.col("high") - F.col("low")).alias("range")))
    assert "range" in indicators.names() and indicators.create("range", bars).columns == ["date", "code", "range"]
    with pytest.raises(KeyError):
        indicators.get("none")
