"""Samples and labels on clocks of their own, and the unit-root test at any level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import clocks as c
from bookflow.operators import distribution as dist
from bookflow.operators import generalization as gen


def frames(spark, x, label, by=None):
    n = len(x) if by is None else None
    samples = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "gidx long, x double").repartition(5)
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(label)], "i long, label int")
    assert n == len(x)
    return samples, labels


@pytest.mark.parametrize("window, stride", [(100, 10), (7, 3), (1, 1), (4, 9)])
def test_lags_across_clocks(spark, window, stride):
    rng = np.random.default_rng(window)
    x = rng.normal(size=1200)
    x[77] = np.nan
    x = np.where(np.isnan(x), 0.0, x)
    label = rng.integers(-1, 2, 700)
    lags = [0, 1, 5, 20, 100]
    samples, labels = frames(spark, x, label)
    rows = c.looked_back(samples, labels, ["x"], lags, window, stride, block=128).collect()
    assert len(rows) == len(label)
    for r in rows:
        for k in lags:
            at = r.i * stride + window - 1 - k
            assert r[f"x_{k}"] == (x[at] if 0 <= at < len(x) else None)
    for r in c.decay(samples, labels, ["x"], lags, 100, window, stride).collect():
        at = np.arange(len(label)) * stride + window - 1 - r.lag
        ok = (at >= 0) & (at < len(x))
        assert r.n == ok.sum()
        assert r.r == pytest.approx(np.corrcoef(x[at[ok]], label[ok])[0, 1] if ok.sum() >= 100 else 0)


def test_samples_move_once_for_all_lags(spark):
    samples, labels = frames(spark, range(50), [0, 1] * 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = c.decay(samples, labels, ["x"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1 and "Python" not in plan


def test_as_many_labels_as_samples_are_aligned(spark):
    samples, labels = frames(spark, range(20), [1] * 20)
    assert c.clock(samples, labels) == (1, 1) and c.clock(samples, labels.limit(3)) == (100, 10)


@pytest.mark.parametrize("window, stride", [(100, 10), (6, 4), (5, 7), (3, 3)])
def test_windows_from_panes(spark, window, stride):
    rng = np.random.default_rng(stride)
    x = 1e8 + rng.normal(size=640)
    long = spark.createDataFrame([(d, "x", k, float(v)) for d in "ab" for k, v in enumerate(x)], "day string, signal string, gidx long, value double").repartition(6)
    got = c.windows(long, window, stride, ("day",), block=32 if window < 32 else 64).collect()
    many = (len(x) - window) // stride + 1
    assert sorted((r.day, r.i) for r in got) == [(d, i) for d in "ab" for i in range(many)]
    for r in got:
        w = x[r.i * stride : r.i * stride + window]
        assert (r.n, r.start, r.end, r.low, r.high) == (window, w[0], w[-1], w.min(), w.max())
        assert r["mean"] == pytest.approx(w.mean(), rel=1e-14) and r["std"] == pytest.approx(w.std(), rel=1e-6)


def test_rows_moved_do_not_grow_with_the_overlap(spark):
    long = spark.range(4000).select(F.lit("x").alias("signal"), F.col("id").alias("gidx"), F.rand(1).alias("value"))
    assert c.panes(long, 10).count() == 400
    assert c.windows(long, 1000, 10).count() == 301 and c.windows(long, 100, 10).count() == 391


def test_level_against_change_of_windows(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=4000))
    i = np.arange((4000 - 100) // 10 + 1)
    change = x[i * 10 + 99] - x[i * 10]
    samples, labels = frames(spark, x, np.concatenate([np.sign(change), np.ones(40)]))
    got = c.level_vs_change(samples.select(F.lit("x").alias("signal"), "gidx", F.col("x").alias("value")), labels).first()
    label = np.sign(change)
    assert got.level_r == pytest.approx(np.corrcoef(x[i * 10 + 99], label)[0, 1]) and got.change_r == pytest.approx(np.corrcoef(change, label)[0, 1])
    assert got.change_auc == pytest.approx(1.0) and got.recommendation == "change"
    assert c.level_vs_change(samples.limit(0).select(F.lit("x").alias("signal"), "gidx", F.col("x").alias("value")), labels).count() == 0


def test_positions(spark):
    rows = [(g, k // 7 if g else None, k) for g in (0, 1) for k in range(50)]
    df = spark.createDataFrame(rows, "g int, b int, k int").repartition(4)
    got = c.with_position(df, F.col("b"), ["k"], ("g",)).collect()
    assert sorted((r.g, r.k, r.gidx) for r in got) == [(g, k, k) for g, _, k in sorted(rows, key=lambda r: (r[0], r[2]))]


def adf(x, lags):
    """The regression by least squares on centred values: statistic and AIC over the rows that `most` lags share."""
    x, d = x - x.mean(), np.diff(x)

    def fit(k, first):
        t = np.arange(first, len(x))
        z = np.stack([np.ones(len(t)), x[t - 1], *[d[t - 1 - j] for j in range(1, k + 1)]], 1)
        y = d[t - 1]
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        rss = ((y - z @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(t) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
        return len(t) * np.log(rss / len(t)) + 2 * z.shape[1], beta[1] / se

    k = min(range(lags + 1), key=lambda k: fit(k, lags + 1)[0])
    return k, fit(k, k + 1)[1]


def test_stationarity_at_any_level(spark, monkeypatch):
    monkeypatch.setattr(dist, "_FAN", 2)
    rng = np.random.default_rng(5)
    x = np.zeros(3000)
    for t in range(1, 3000):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    cases = {"zero": x, "large": x + 1e8, "fine": 1e5 + 1e-3 * x, "walk": 1e6 + np.cumsum(rng.normal(size=3000)), "line": np.arange(3000.0), "flat": np.ones(3000)}
    rows = [(s, k, float(v)) for s, xs in cases.items() for k, v in enumerate(xs)]
    long = spark.createDataFrame(rows, "signal string, gidx long, value double").repartition(4)
    monkeypatch.setattr(dist, "halo", lambda df, n, f=dist.halo: f(df, n, 512))
    monkeypatch.setattr(dist, "BLOCK", 512)
    got = {r.signal: r for r in dist.stationarity(long).collect()}
    for s in ("zero", "large", "fine", "walk"):
        k, tau = adf(cases[s], int(np.ceil(12 * 30**0.25)))
        assert got[s].lags == k and got[s].adf_statistic == pytest.approx(tau, rel=1e-6)
    assert got["large"].adf_statistic == pytest.approx(got["zero"].adf_statistic, rel=1e-6) and got["fine"].p_value < 1e-9
    assert not got["walk"].is_stationary and (got["flat"].adf_statistic, got["flat"].p_value) == (0.0, 1.0)
    assert np.isfinite(got["line"].adf_statistic)


def test_walk_forward_at_any_level(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=600)
    rows = [("v", f"d{k // 100}", int(rng.integers(-1, 2)), float(v)) for k, v in enumerate(x)]
    make = lambda level: spark.createDataFrame([(s, d, y, v + level) for s, d, y, v in rows], "signal string, date string, label int, value double")
    want, got = (sorted((r.test_day, r.train_n, r.accuracy) for r in gen.walk_forward(make(level), "v").collect()) for level in (0.0, 1e9))
    assert got == want
