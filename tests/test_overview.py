"""Overview per split, categorical columns, signal metadata, clusters."""

import numpy as np
import pytest

from bookflow.operators import correlation as cor
from bookflow.operators import overview as ov
from bookflow.schema import CATEGORIES


def test_overview_per_split(spark):
    rng = np.random.default_rng(0)
    x = 1e9 + rng.normal(size=400)
    rows = [("train" if k < 250 else "val", f"d{k // 50}", int(rng.integers(-1, 2)) if k % 9 else None, float(x[k]), [float("nan"), float("inf"), None][k % 3] if k % 20 == 0 else 1.0) for k in range(400)]
    df = spark.createDataFrame(rows, "split string, date string, label int, x double, y double").repartition(5)
    got = {(r.split, r.signal): r for r in ov.overview(df, ["x", "y"]).collect()}
    assert set(got) == {(s, c) for s in ("train", "val", None) for c in ("x", "y", None)}
    for split, own in (("train", rows[:250]), ("val", rows[250:]), (None, rows)):
        whole = got[split, None]
        assert (whole.n_samples, whole.n_labels, whole.n_days) == (len(own), sum(r[2] is not None for r in own), len({r[1] for r in own}))
        assert [whole.down_count, whole.stable_count, whole.up_count] == [sum(r[2] == k for r in own) for k in (-1, 0, 1)]
        ys = [r[4] for r in own if r[4] is not None]
        assert whole.total_values == len(own) + len(ys) and whole.nan_count == sum(y != y for y in ys) and whole.inf_count == sum(y == float("inf") for y in ys)
        xs = np.array([r[3] for r in own])
        assert got[split, "x"]["mean"] == pytest.approx(xs.mean(), rel=1e-15) and got[split, "x"]["std"] == pytest.approx(xs.std(), rel=1e-6)
        assert got[split, "x"].is_clean and not got[split, "y"].is_clean and got[split, "y"]["std"] == 0 and whole["mean"] is None


def test_the_overview_scans_once(spark, sf):
    from bookflow.plans.overview import split_overview

    df = split_overview(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan and "ReusedExchange" not in plan


def test_categories(spark):
    rows = [(0.0, 3.0, 1.0, 7.0, 2.1), (1.0, 9.0, 1.0, -3.0, 2.1), (None, 0.0, 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in CATEGORIES))
    got = {r.name: tuple(r)[1:] for r in ov.categories(df, CATEGORIES).collect()}
    assert got == {"book_valid": (2, 2, 0, 0, True), "time_regime": (3, 3, 1, 3, False), "mbo_ready": (3, 1, 0, 1, True), "invalidity_delta": (2, 2, 0, 0, True), "schema_version_feature": (3, 2, 1, 0, False)}


def test_metadata_of_unknown_indices(spark):
    got = {r["index"]: (r.signal, r.kind, r.expected_sign) for r in ov.described(spark.createDataFrame([(84, 1.0), (93, 1.0), (400, 1.0)], "index int, x double")).collect()}
    assert got == {84: ("true_ofi", "continuous", "+"), 93: ("time_regime", "categorical", "N/A"), 400: ("signal_400", "unknown", "?")}


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_the_greedy_rule(spark, seed):
    rng = np.random.default_rng(seed)
    p = 9
    names = [f"s{k}" for k in range(p)]
    r = np.round(rng.uniform(-1, 1, (p, p)), 3)
    rows = [(i, j, names[i], names[j], None if (i + j) % 7 == 3 else float(r[i, j])) for i in range(p) for j in range(i, p)]
    value = {(i, j): abs(x or 0.0) for i, j, _, _, x in rows}
    free, want = list(range(p)), []
    while free:
        own = [free[0], *[j for j in free[1:] if value[free[0], j] > 0.5]]
        free = [j for j in free if j not in own]
        inner = [value[a, b] for x, a in enumerate(own) for b in own[x + 1 :]]
        want.append((len(want), [names[k] for k in own], round(float(np.mean(inner)), 9) if inner else 1.0))
    got = cor.clusters(spark.createDataFrame(rows, "i int, j int, signal_a string, signal_b string, r double"), names).collect()
    assert sorted((x.cluster_id, x.signals, round(x.mean_within, 9)) for x in got) == want
