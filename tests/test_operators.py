"""Operators against NumPy on small series with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.functions import stats
from bookflow.operators import correlation as cor
from bookflow.operators import distribution as dist
from bookflow.operators import generalization as gen
from bookflow.operators import labels as lab
from bookflow.operators import predictive as pre
from bookflow.operators import quality as q
from bookflow.operators import regimes as reg
from bookflow.operators import temporal as tem
from bookflow.operators.frames import halo, quantiles, ranked, with_gidx


def series(spark, *columns, names="xyzw", label=None, days=1):
    """A canonical frame of one or more series, dealt over days."""
    n = len(columns[0])
    label = [0] * n if label is None else [int(x) for x in label]
    size = -(-n // days)
    rows = [(f"d{k // size:03d}", k % size, k % 5, label[k], *[float(c[k]) for c in columns]) for k in range(n)]
    schema = "date string, seq long, regime int, label int, " + ", ".join(f"{names[i]} double" for i in range(len(columns)))
    return with_gidx(spark.createDataFrame(rows, schema))


def long(df, *signals):
    from bookflow.operators.frames import long_form

    return long_form(df, list(signals))


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize("counts,ratio,balanced", [((100, 100, 100), 1.0, True), ((50, 400, 50), 8.0, False), ((0, 3, 2), 3.0, False)])
def test_label_distribution(spark, counts, ratio, balanced):
    labels = [-1] * counts[0] + [0] * counts[1] + [1] * counts[2]
    got = one(q.label_distribution(spark.createDataFrame([(x,) for x in labels], "label int")))
    assert (got["down_count"], got["stable_count"], got["up_count"]) == counts
    assert got["imbalance_ratio"] == ratio and got["is_balanced"] == balanced


def test_label_distribution_of_nothing(spark):
    got = one(q.label_distribution(spark.createDataFrame([], "label int")))
    assert got["total"] == 0 and got["up_pct"] == 0 and got["majority_class"] == "Down"


def test_data_quality(spark):
    rows = [("a", 1.0), ("a", math.nan), ("b", math.inf), ("b", -math.inf), ("c", 2.0)]
    got = one(q.data_quality(spark.createDataFrame(rows, "signal string, value double")))
    assert (got["total_values"], got["finite_count"], got["nan_count"], got["inf_count"]) == (5, 2, 1, 2)
    assert got["columns_with_nan"] == ["a"] and got["columns_with_inf"] == ["b"] and not got["is_clean"]


def test_merge_equals_whole(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(5, 1, 500), rng.normal(-3, 2, 300)])
    df = spark.createDataFrame([("x", k % 7, float(v)) for k, v in enumerate(x)], "signal string, part int, value double")
    got = one(q.merge_stats(q.column_stats(df, ("part", "signal"))))
    assert got["n"] == 800
    np.testing.assert_allclose([got["mean"], got["std"], got["min"], got["max"]], [x.mean(), x.std(), x.min(), x.max()], rtol=1e-10)


def test_categorical(spark):
    df = spark.createDataFrame([(2.1,)] * 5 + [(3.0,)], "schema_version_feature double")
    got = one(q.categorical(df, "schema_version_feature", [2.1]))
    assert not got["is_valid"] and got["value_counts"] == [5, 1]
    assert one(q.categorical(df.where("schema_version_feature < 3"), "schema_version_feature", [2.1]))["is_valid"]
    assert one(q.categorical(df, "schema_version_feature", None))["is_valid"]


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, 2000).astype(float)
    df = spark.createDataFrame([("x", float(v)) for v in x] + [("x", math.nan), ("x", None)], "signal string, value double")
    values = ranked(df, buckets=8)
    for r in values.collect():
        assert r.before == (x < r.value).sum() and r.n == (x == r.value).sum()
    got = {r.p: r.q for r in quantiles(values, [0.0, 0.1, 0.5, 0.75, 1.0]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(x, p))


def test_halo_holds_history(spark):
    df = series(spark, np.arange(50))
    got = halo(df, 3, block=10).groupBy("_block").agg(F.min("gidx").alias("a"), F.max("gidx").alias("b")).orderBy("_block").collect()
    assert [(r.a, r.b) for r in got[:5]] == [(0, 9), (7, 19), (17, 29), (27, 39), (37, 49)]


def test_transitions(spark):
    df = series(spark, np.zeros(9), label=[-1] * 3 + [0] * 3 + [1] * 3)
    got = {(r.from_label, r.to_label): r for r in lab.transitions(df).collect()}
    assert got[-1, -1].probability == pytest.approx(2 / 3) and got[-1, 0].n == 1 and got[1, -1].n == 0
    assert got[0, 0].persistence == pytest.approx(2 / 3 - 1 / 3)
    cyclic = {(r.from_label, r.to_label): r.probability for r in lab.transitions(series(spark, np.zeros(300), label=[-1, 0, 1] * 100)).collect()}
    assert cyclic[-1, 0] == cyclic[0, 1] == 1


def test_autocorrelation(spark):
    rng = np.random.default_rng(2)
    x = np.convolve(rng.normal(size=420), np.ones(5), "valid")
    df = series(spark, x, np.full(len(x), 0.1), days=4)
    got = {(r.signal, r.lag): r.acf for r in lab.autocorrelation(long(df, "x", "y"), 10).collect()}
    d = x - x.mean()
    for k in range(11):
        assert got["x", k] == pytest.approx(np.mean(d[: len(d) - k] * d[k:]) / x.var())
        assert got["y", k] == 1.0


def test_lead_and_decay(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    y = np.roll(x, 2)
    label = np.sign(np.roll(x, 5)).astype(int)
    df = series(spark, x, y, label=label, days=3)
    top = tem.lead_lag(tem.cross_correlation(df, ["x", "y"], 5)).collect()[0]
    assert (top.leader, top.follower, top.optimal_lag, top.is_significant) == ("x", "y", 2, True)
    cc = {(r.lag): r.r for r in tem.cross_correlation(df, ["x", "y"], 5).collect()}
    for k in range(-5, 6):
        a, b = (x[: len(x) - k], y[k:]) if k >= 0 else (x[-k:], y[:k])
        assert cc[k] == pytest.approx(np.corrcoef(a, b)[0, 1])
    best = {r.signal: r.optimal_lag for r in tem.decay_summary(tem.predictive_decay(long(df, "x"))).collect()}
    assert best["x"] == 5


def test_rank_metrics(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(-1, 2, 400)
    x = np.round(label + rng.normal(size=400), 1)
    got = one(pre.rank_metrics(pre.labelled(long(series(spark, x, label=label), "x"))))
    mid = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got["spearman_r"] == pytest.approx(np.corrcoef(mid(x), mid(label))[0, 1])
    up, rest = x[label == 1], x[label != 1]
    assert got["auc_up"] == pytest.approx(np.mean((up[:, None] > rest) + 0.5 * (up[:, None] == rest)))
    down, rest = x[label == -1], x[label != -1]
    assert got["auc_down"] == pytest.approx(np.mean((down[:, None] < rest) + 0.5 * (down[:, None] == rest)))


def test_mutual_information(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(-1, 2, 300)
    x = label + rng.normal(size=300)
    got = one(pre.mutual_information(long(series(spark, x, label=label), "x"), buckets=8))
    psi = lambda n: -0.5772156649015329 + sum(1 / k for k in range(1, n))
    near = []
    for a, c in zip(x, label):
        own = np.sort(np.abs(x[label == c] - a))
        near.append((psi(int((np.abs(x - a) < own[3]).sum())), psi(int((label == c).sum()))))
    want = psi(300) + psi(3) - np.mean([b for _, b in near]) - np.mean([a for a, _ in near])
    assert got["mi_nats"] == pytest.approx(max(0.0, want), abs=1e-6)
    flat = one(pre.mutual_information(long(series(spark, np.full(300, 2.0), label=label), "x")))
    assert flat["mi_nats"] == pytest.approx(0.0, abs=0.02)


def test_binned(spark):
    x = np.arange(1000.0)
    got = pre.binned_probabilities(long(series(spark, x, np.full(1000, 3.0), label=(x >= 500).astype(int)), "x", "y")).collect()
    assert {r.signal for r in got} == {"x"} and sorted(r.n for r in got) == [100] * 10
    assert {r.bin: r.p_up for r in got}[9] == 1.0


def test_p_values():
    assert stats.correlation_p(0.5, 10) == pytest.approx(0.141, abs=5e-4)
    assert stats.correlation_p(0.0, 10) == 1.0 and stats.correlation_p(1.0, 10) == 0.0
    assert math.isnan(stats.correlation_p(0.1, 2))


def test_structure(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=500)
    x = np.stack([a, a + 0.01 * rng.normal(size=500), rng.normal(size=500), np.full(500, 5.0)])
    df = series(spark, *x)
    names = ["x", "y", "z", "w"]
    vif = {r.signal: r for r in cor.vif(df, names).collect()}
    assert vif["x"].is_severe and vif["y"].is_severe and vif["z"].vif == pytest.approx(1.0, abs=0.05) and vif["w"].vif == 1.0
    parts = cor.pca(df, names).collect()
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(x[:3])))[::-1] / 3
    np.testing.assert_allclose([r.explained for r in parts][:3], want, atol=1e-9)
    matrix = cor.correlation_matrix(df, names)
    groups = [r.signals for r in cor.clusters(matrix, names).collect()]
    assert groups == [["x", "y"], ["z"], ["w"]]
    assert [(r.signal_a, r.signal_b) for r in cor.redundant_pairs(matrix).collect()] == [("x", "y")]
    with pytest.raises(ValueError):
        cor.vif(df.limit(50), names)


def test_distribution(spark):
    rng = np.random.default_rng(7)
    x, e = rng.normal(size=3000), rng.exponential(size=3000)
    got = {r.signal: r for r in dist.distribution_stats(long(series(spark, x, e, np.full(3000, 5.0)), "x", "y", "z"), step=10).collect()}
    assert got["y"].skewness > 1 and got["y"].p_normal < 1e-4 < got["x"].p_normal
    assert got["z"].std == 0 and got["z"].pct_outliers == 0 and got["z"].p_normal is None
    assert got["x"].median == pytest.approx(np.median(x))


def test_stationarity(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=1500)
    got = {r.signal: r for r in dist.stationarity(long(series(spark, x, np.cumsum(rng.normal(size=1500)), np.full(1500, 1.0)), "x", "y", "z")).collect()}
    assert got["x"].is_stationary and not got["y"].is_stationary and got["z"].p_value == 1.0
    k = got["x"].lags
    d = np.diff(x)
    at = np.arange(k, len(d))
    z = np.column_stack([np.ones(len(at)), x[at], *[d[at - 1 - i] for i in range(k)]])
    beta, *_ = np.linalg.lstsq(z, d[at], rcond=None)
    res = d[at] - z @ beta
    se = math.sqrt(res @ res / (len(at) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
    assert got["x"].adf_statistic == pytest.approx(beta[1] / se, rel=1e-6)


def test_rolling(spark):
    rng = np.random.default_rng(9)
    drift = rng.normal(size=2000) + np.linspace(0, 5, 2000)
    got = {r.signal: r for r in dist.rolling_stats(long(series(spark, drift, rng.normal(size=2000)), "x", "y"), 200, 10).collect()}
    assert not got["x"].is_mean_stable and got["x"].mean_drift > 0 and got["x"].mean_range > 1 and got["y"].is_mean_stable
    starts = range(0, 1800, 180)
    means = [drift[a : a + 200].mean() for a in starts]
    assert got["x"].n_windows == len(means) and got["x"].mean_range == pytest.approx(max(means) - min(means))


def test_days(spark):
    rng = np.random.default_rng(10)
    label = rng.integers(-1, 2, 250)
    x = label + 0.1 * rng.normal(size=250)
    df = long(series(spark, x, label=label, days=5), "x")
    got = one(gen.day_stability(gen.per_day(df)))
    assert got["n_days"] == 5 and got["is_stable"] and got["stability_score"] > 10
    folds = gen.walk_forward(df, "x").orderBy("test_day").collect()
    assert [r.train_days for r in folds] == [3, 4]
    mu, sd = x[:150].mean(), x[:150].std()
    said = np.where(x[150:200] > mu + sd / 2, 1, np.where(x[150:200] < mu - sd / 2, -1, 0))
    assert folds[0].accuracy == pytest.approx((said == label[150:200]).mean())
    assert gen.generalization_summary(df, "x")["generalization_assessment"] == "GOOD"


def test_regimes(spark):
    rng = np.random.default_rng(11)
    label = rng.integers(-1, 2, 500)
    df = series(spark, label + 0.5 * rng.normal(size=500), np.full(500, 1.0), label=label)
    rows = {(r.signal, r.regime): r for r in reg.regime_correlations(long(df, "x", "y"), {"x": "+"}).collect()}
    assert rows["x", 0].is_significant and rows["x", 0].sign_consistent
    assert rows["y", 0].correlation == 0 and rows["y", 0].p_value == 1 and not rows["y", 0].sign_consistent
    assert len(reg.regime_stats(df).collect()) == 5
    assert set(reg.regime_summary(df, long(df, "x"))["overall_regime_importance"]) == {0, 1, 2, 3, 4}


def test_groups(spark):
    rows = [("a", 0.1, True), ("b", 0.02, True), ("c", 0.005, True), ("d", 0.08, False), ("e", 0.05, True)]
    metrics = spark.createDataFrame(rows, "signal string, pearson_r double, sign_consistent boolean")
    matrix = spark.createDataFrame([(0, 4, "a", "e", 0.8)], "i int, j int, signal_a string, signal_b string, r double")
    got = {r.signal: r.group for r in pre.predictive_groups(metrics, matrix).collect()}
    assert got == {"a": "primary", "b": "moderate", "c": "low_priority", "d": "contrarian", "e": "redundant"}


def test_temporal_summary(spark):
    x = np.sin(np.arange(400) / 30)
    got = tem.temporal_summary(series(spark, x, np.roll(x, 3), label=np.sign(x)), ["x", "y"], 50, 5)
    assert got["sequence_model_justified"] and got["optimal_lookback"] == 50
