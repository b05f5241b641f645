"""Every family on the bars, whose vwap the indicator of that name replaces."""

import pytest

from barloom.operators import indicators
from barloom.plans import studies
from barloom.sources.bars import weekly_bars


def test_the_volume_family_has_one_vwap(spark):
    bars = weekly_bars(spark, "/root/testdata/sf0.001").where("code <= 3")
    got = indicators.family("volume", bars)
    assert sorted(got.columns) == sorted({*bars.columns, "obv", "vwap", "ad", "mfi"}) and got.count() == bars.count()
    key = lambda df: {(r.date, r.code): r.vwap for r in df.select("date", "code", "vwap").collect()}
    assert key(got) == key(indicators.one("ind_vwap", bars))


@pytest.mark.parametrize("name", sorted(indicators.FAMILIES))
def test_family_queries_can_be_resolved(spark, name):
    columns = studies.QUERIES[f"ind_family_{name}"](spark, "/root/testdata/sf0.001").columns
    assert len(columns) == len(set(columns))
