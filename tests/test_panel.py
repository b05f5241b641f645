"""Every panel operator on Spark against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from barloom.plans import panel

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if c in ("date", "data_start", "data_end"):
            df[c] = pd.to_datetime(df[c])
    keys = [c for c in ("date", "code", "k", "bucket") if c in df.columns and not (c == "k" and "j" in df.columns)]
    return df.sort_values(keys).reset_index(drop=True) if keys else df


@pytest.mark.parametrize("name", sorted(panel.queries()))
def test_two_engines_agree(spark, duck, name):
    ours, theirs = ordered(panel.queries()[name](spark, SF).toPandas()), ordered(duck.sql(panel.duck_sql(name)).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=1e-9, atol=2e-6)
