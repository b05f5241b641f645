"""Recursive indicators against plain loops."""

import datetime

import numpy as np
import pandas as pd

from barloom.plans import smoothed


def test_ema_is_the_recursion_from_the_mean_of_the_first_values():
    x = pd.Series(np.random.default_rng(3).uniform(1, 9, 40))
    x[5] = np.nan
    known, n = x.dropna(), 12
    want, held = {}, known.iloc[:n].mean()
    want[known.index[n - 1]] = held
    for i in range(n, len(known)):
        held += 2 / (n + 1) * (known.iloc[i] - held)
        want[known.index[i]] = held
    np.testing.assert_allclose(smoothed.ema(x, n), pd.Series(want).reindex(x.index))
    assert smoothed.ema(x[:5], n).isna().all()


def test_every_indicator_runs_over_codes_with_gaps_and_short_ones(spark):
    rng, rows = np.random.default_rng(4), []
    for code, n in ((1, 60), (2, 3), (3, 60)):
        for k in range(n):
            c = None if k % 11 == 7 else float(rng.uniform(5, 9))
            rows.append((datetime.date(2020, 1, 1) + datetime.timedelta(days=k), code, c and c + 1, c and c - 1, c))
    bars = spark.createDataFrame(rows, "date date, code long, high double, low double, close double")
    for name, (_, columns) in smoothed.INDICATORS.items():
        got = smoothed.apply(bars, name).toPandas()
        assert len(got) == len(rows) and got[got.code == 2][list(columns)].isna().all().all() and got[got.code == 1][columns[0]].notna().any()
    rsi = smoothed.apply(bars, "ind_rsi").toPandas().rsi6.dropna()
    assert rsi.between(0, 100).all()
