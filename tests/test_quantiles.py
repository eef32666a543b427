"""Exact quantiles by sketch and refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import frames
from bookflow.operators.predictive import binned_probabilities

PS = [0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1]


def check(spark, cases, **how):
    rows = [(s, float(v)) for s, vs in cases.items() for v in vs]
    long = spark.createDataFrame(rows, "signal string, value double").repartition(5)
    got = {(r.signal, r.p): r.q for r in frames.exact_quantiles(long, PS, **how).collect()}
    want = {}
    for s, vs in cases.items():
        own = np.array(vs, float)
        own = own[np.isfinite(own)]
        if own.size:
            want |= {(s, p): np.quantile(own, p) for p in PS}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-300), k


@pytest.mark.parametrize("how", [{}, {"accuracy": 50}, {"accuracy": 50, "bracket": 40}, {"accuracy": 3, "bracket": 5}])
def test_equal_to_sorting_all(spark, how):
    rng = np.random.default_rng(1)
    check(
        spark,
        {
            "normal": rng.normal(size=3000),
            "ties": rng.integers(0, 4, 2000),
            "one": [5.0],
            "two": [1.0, -1.0],
            "constant": [2.5] * 500,
            "heavy": np.concatenate([np.zeros(900), rng.normal(size=100)]),
            "wild": np.concatenate([rng.normal(size=300), [np.nan, np.inf, -np.inf, 1e300, -1e300, 5e-324]]),
            "none": [np.nan],
        },
        **how,
    )


def test_a_sketch_that_misses_does_not_matter(spark, monkeypatch):
    """Whatever the sketch says, the counts open the bracket."""
    monkeypatch.setattr(F, "percentile_approx", lambda c, grid, accuracy: F.array(*[F.lit(1e6 + k) for k in range(len(grid))]))
    check(spark, {"x": range(101), "y": [3.0] * 7})


def test_only_brackets_are_shuffled(spark):
    rng = np.random.default_rng(2)
    long = spark.createDataFrame([("x", float(v)) for v in rng.normal(size=50_000)], "signal string, value double").repartition(4).cache()
    got = frames.exact_quantiles(long, [0.25, 0.5, 0.75])
    got.collect()
    held = got._jdf.queryExecution().executedPlan()
    text = held.toString()
    assert "_at" in text and "isFinalPlan=true" in text
    brackets = frames._Brackets(spark, "signal", {"x": [(float(np.quantile(long.toPandas()["value"], p - 2e-4)), float(np.quantile(long.toPandas()["value"], p + 2e-4))) for p in (0.25, 0.5, 0.75)]})
    assert brackets.place(long).where("_at % 2 = 1").count() < 100
    long.unpersist()


def test_bins_of_labels(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=700), 1), rng.integers(-1, 2, 700)
    long = spark.createDataFrame([("x", float(a), int(b)) for a, b in zip(x, y)] + [("c", 1.0, 0)] * 5 + [("x", float("nan"), 1)], "signal string, value double, label int")
    got = {r.bin: r for r in binned_probabilities(long, 10).collect()}
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 11)))
    at = np.searchsorted(edges[1:-1], x, side="left")
    assert set(got) == set(at.tolist())
    for b, r in got.items():
        own = at == b
        assert (r.signal, r.n, r.min, r.max) == ("x", own.sum(), x[own].min(), x[own].max()) and r.p_up == pytest.approx((y[own] == 1).mean())
