"""Evaluation against pandas and numpy on one synthetic panel."""

import datetime

import numpy as np
import pandas as pd
import pytest

from barloom.operators import evaluation as ev

N, K = 70, 30


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    dates = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(N)]
    close = pd.DataFrame(100 + rng.normal(0, 0.5, (N, K)).cumsum(axis=0), index=dates, columns=range(K))
    a, b = pd.DataFrame(rng.normal(size=(N, K)), index=dates, columns=range(K)), pd.DataFrame(rng.normal(size=(N, K)).round(1), index=dates, columns=range(K))
    a = a.mask(rng.random((N, K)) < 0.1)
    industry, cap = rng.choice(["x", "y", "z"], K), rng.uniform(1e9, 1e11, K)
    none = lambda x: None if x != x else float(x)
    rows = [(d, k, float(close.loc[d, k]), none(a.loc[d, k]), none(b.loc[d, k]), str(industry[k]), float(cap[k])) for d in dates for k in range(K)]
    df = spark.createDataFrame(rows, "date date, code long, close double, a double, b double, industry string, cap double").cache()
    return df, close, a, b, industry, cap


def spearman(f, r):
    ok = f.notna() & r.notna()
    return f.where(ok).rank(axis=1).corrwith(r.where(ok).rank(axis=1), axis=1).where(ok.sum(axis=1) >= 2)


def wide(df, column):
    return df.toPandas().pivot(index="date", columns="code", values=column).astype(float)


def test_measures(panel):
    df, close, a, b, _, _ = panel
    r = close.pct_change().shift(-1)
    got = ev.evaluate(df, ["a", "b"], limit=None, neutral=False).toPandas().set_index("factor")
    for name, f in (("a", a), ("b", b)):
        ic = spearman(f, r).dropna()
        z = f.sub(f.mean(axis=1), axis=0).div(f.std(axis=1, ddof=0), axis=0)
        p = z * r.sub(r.mean(axis=1), axis=0)
        fr = (p.sum(axis=1) / (p.notna().sum(axis=1) - 1))[p.notna().sum(axis=1) >= 10]
        g = got.loc[name]
        assert g.ic_mean == pytest.approx(ic.mean()) and g.ic_std == pytest.approx(ic.std()) and g.fr_mean == pytest.approx(fr.mean()) and g.n_periods == len(fr)
        assert g.t_stat == pytest.approx(ic.mean() / (ic.std() / np.sqrt(len(fr)))) and g.fr_annual == pytest.approx(fr.mean() * 252)
    flat = ev.evaluate(df, ["a"], limit=0.004, neutral=False).first()
    ok = close.pct_change().abs() < 0.004
    ic = spearman(a.where(ok), r.where(ok.shift(-1, fill_value=False))).dropna()
    assert flat.ic_mean == pytest.approx(ic.mean(), abs=1e-9)


def test_neutral_panels(panel):
    df, _, a, _, industry, cap = panel
    got = wide(ev.neutralise(df, ["a"]), "a")
    x = np.column_stack([np.ones(K), industry == "y", industry == "z", (np.log(cap) - np.log(cap).mean()) / np.log(cap).std()]).astype(float)
    for d in a.index[:5]:
        ok = a.loc[d].notna().to_numpy()
        beta = np.linalg.lstsq(x[ok], a.loc[d][ok].to_numpy(), rcond=None)[0]
        np.testing.assert_allclose(got.loc[d][ok], a.loc[d][ok] - x[ok] @ beta, atol=1e-9)
    few = ev.neutralise(df.where("code < 10"), ["a"])
    assert few.subtract(df.where("code < 10")).count() == 0


def test_combinations(panel):
    df, _, a, b, _, _ = panel
    z = lambda f: f.sub(f.mean(axis=1), axis=0).div(f.std(axis=1), axis=0)
    np.testing.assert_allclose(wide(ev.combine_equal(df, ["a", "b"]), "combined"), pd.concat([z(a), z(b)]).groupby(level=0).mean(), atol=1e-9)
    np.testing.assert_allclose(wide(ev.combine_icir(df, {"a": -1.0, "b": 3.0}), "combined"), z(a).fillna(0) * 0.25 + z(b).fillna(0) * 0.75, atol=1e-9)
    rank = lambda f: f.rank(axis=1, pct=True)
    np.testing.assert_allclose(wide(ev.combine_rank(df, ["a", "b"]), "combined"), pd.concat([rank(a), rank(b)]).groupby(level=0).mean(), atol=1e-9)


def test_systems(panel):
    df, close, a, b, _, _ = panel
    told = ev.evaluate_system(df, ["a", "b"], neutral=False).toPandas()
    assert told.ic_mean.abs().is_monotonic_decreasing and set(told.coverage) == {1.0}
    decay = ev.ic_decay(ev.evaluate_horizons(df, ["a", "b"], (1, 2), limit=None, neutral=False), (1, 2)).toPandas().set_index("factor")
    for name, f in (("a", a), ("b", b)):
        want = [spearman(f, close.pct_change(p).shift(-p)).mean() for p in (1, 2)]
        assert decay.loc[name, ["ic_1", "ic_2"]].astype(float).tolist() == pytest.approx(want) and decay.loc[name, "peak"] == 1 + int(np.argmax(np.abs(want)))
    held = ev.forward_returns(df)
    zc = lambda f: (f - f.mean()) / (f.std() + 1e-10)
    r = close.pct_change().shift(-1)
    power = ev.model_power(held, {"a": 0.5, "b": 0.5}).first()
    ic = spearman((zc(a) * 0.5 + zc(b) * 0.5), r).dropna()
    assert power.ic_mean == pytest.approx(ic.mean()) and power.n_periods == len(ic)
    counted = ev.factor_count(held, {"a": 0.1, "b": -0.3}).toPandas()
    assert counted.added_factor.tolist() == ["b", "a"] and counted.ic_mean[1] == pytest.approx(ic.mean())
    pairs = ev.long(held, ["a", "b"], ["date", "code", "r"])
    corr = ev.correlation(ev.rolling_factor_returns(pairs)).toPandas()
    assert len(corr) == 4 and ev.independent(ev.evaluate(df, ["a", "b"], limit=None, neutral=False), ev.correlation(ev.factor_returns(pairs)), above=0.0) in (["a"], ["b"])
    q = ev.quantile_returns(held, "b", 5).toPandas()
    d = close.index[3]
    want = r.loc[d].groupby(pd.qcut(b.loc[d], 5, labels=False, duplicates="drop")).mean()
    np.testing.assert_allclose(q[q.date == d].sort_values("bucket").mean_return, want)


def test_weighted_windows():
    rng = np.random.default_rng(1)
    x, m = rng.normal(size=60), rng.normal(size=60)
    w = 0.5 ** (np.arange(20)[::-1] / 5)
    w /= w.sum()
    assert ev.weighted_mean(x, 20, 5)[40] == pytest.approx(np.sum(w * x[21:41]))
    assert ev.weighted_std(x, 20, 5)[40] == pytest.approx(np.sqrt(np.cov(x[21:41], aweights=w, ddof=0)))
    c = np.cov(x[21:41], m[21:41], aweights=w, ddof=0)
    assert ev.weighted_beta(x, m, 20, 5, 10)[40] == pytest.approx(c[0, 1] / c[1, 1])


def test_rolling_regression(panel):
    df, _, a, b, _, _ = panel
    got = wide(ev.regression_residuals(df, "b", ["a", "cap"], 10), "residual")
    t, k = 30, 4
    y, x = b.iloc[21:31, k].to_numpy(), a.iloc[21:31, k].to_numpy()
    ok = ~np.isnan(x)
    if ok[-1]:
        p = np.polyfit(x[ok], y[ok], 1)
        assert got.iloc[t, k] == pytest.approx(y[-1] - np.polyval(p, x[-1]), abs=1e-6)
