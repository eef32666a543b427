"""Job stages, sinks and advice."""

import numpy as np
import pytest

from bookflow import jobs
from bookflow.operators import advice
from bookflow.sources.tables import TICK_SIGNALS, ticks
from tests.test_operators import series


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    label = rng.integers(-1, 2, 600)
    x = label + 0.3 * rng.normal(size=600)
    stages = jobs.analyze(series(spark, x, rng.normal(size=600), label=label, days=5), ["x", "y"], {"x": "+"})
    path = str(tmp_path_factory.mktemp("jobs"))
    jobs.save_json(stages, path)
    return jobs.read_json(spark, stages, path)


def test_results_hold(saved):
    assert not [r.name for r in jobs.validate(saved).collect() if not r.passed]


def _made(spark, **faults):
    """Small results that hold, but for the faults."""
    x = {"total": 10, "auc": 0.6, "p": 0.5, "acf": 1.0, "size": 10} | faults
    row = lambda **c: spark.createDataFrame([tuple(c.values())], list(c))
    return {
        "overview": {
            "label_distribution": row(down_count=3, stable_count=3, up_count=4, total=x["total"]),
            "days": spark.createDataFrame([("a", 4), ("b", 6)], "date string, n_samples long"),
            "size": row(n_samples=x["size"]),
        },
        "labels": {
            "autocorrelation": spark.createDataFrame([(0, x["acf"]), (1, 0.2)], "lag int, acf double"),
            "transitions": spark.createDataFrame([(k, j, x["p"] if k == 0 and j < 1 else 0.5 if j < 1 else 0.0) for k in (-1, 0, 1) for j in (-1, 0, 1)], "from_label int, to_label int, probability double"),
        },
        "predictive": {"metrics": spark.createDataFrame([(x["auc"], 0.5, None)], "auc_up double, auc_down double, mi_nats double")},
        "other": {"free": row(x=1)},
    }


def test_checks_are_observed_on_the_write(spark, tmp_path):
    sc = spark.sparkContext

    def jobs_of(name, f):
        sc.setJobGroup(name, name)
        try:
            got = f()
        finally:
            sc._jsc.sc().clearJobGroup()
        return got, len(sc.statusTracker().getJobIdsForGroup(name))

    stages = _made(spark)
    _, plain = jobs_of("plain", lambda: jobs.save_json(stages, str(tmp_path / "a")))
    failed, checked = jobs_of("checked", lambda: jobs.save_checked(stages, str(tmp_path / "b")))
    assert failed == [] and plain == checked > 0
    read = lambda at: {(s, r): sorted(map(str, spark.read.json(str(tmp_path / at / s / r)).collect())) for s in stages for r in stages[s]}
    assert read("a") == read("b")
    for fault, names in (({"total": 11}, ["labels are known"]), ({"auc": 1.5}, ["AUC up is a probability"]), ({"p": 0.2}, ["transitions add up"]), ({"acf": 0.9, "size": 9}, ["a series equals itself", "days hold all samples"])):
        bad = _made(spark, **fault)
        assert sorted(jobs.save_checked(bad, str(tmp_path / "c"))) == sorted(names)
        assert sorted(r.name for r in jobs.validate(bad).collect() if not r.passed) == sorted(names)
    empty = {s: {r: df.limit(0) for r, df in results.items()} for s, results in stages.items() if s == "predictive"}
    assert jobs.save_checked(empty, str(tmp_path / "d")) == []


def test_advice_follows(saved):
    got = {(r.topic, r.code): r.detail for r in saved["training"]["advice"].collect()}
    assert got["features", "primary_signals"].startswith("x") and ("data", "clean") in got and ("training", "predictive_baseline") in got
    assert ("data", "imbalanced_labels") not in got and ("training", "low_stability") not in got
    assert got["training", "closed_samples"] == "120 samples are outside market hours"
    assert saved["generalization"]["summary"].first().generalization_assessment == "GOOD"
    assert {r.code for r in saved["generalization"]["advice"].collect()} >= {"few_days"}


def test_report(spark, saved, tmp_path):
    jobs.save_report(spark, saved, str(tmp_path / "report"))
    said = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "WALK" not in said and "walk_forward" in said and "GOOD" in said and "OVERVIEW" in said


def test_rules(spark):
    rows = [("stable_pct", 85.0), ("is_clean", 0.0), ("components_for_90", 4.0), ("n_signals", 8.0), ("redundant_pairs", 6.0), ("mean_half_life", 30.0), ("persistent_predictors", 0.0), ("leading_pairs", 0.0), ("stability_score", 0.4), ("walk_forward_accuracy", 0.3), ("importance_ratio", 1.5)]
    facts = spark.createDataFrame([(f, v, None) for f, v in rows], "fact string, value double, names string")
    got = [r.code for r in advice.training_advice(facts).collect()]
    assert got == ["imbalanced_labels", "not_clean", "few_components", "redundant_pairs", "sequence_model", "low_stability", "regime_stable", "balance_labels", "reduce_signals", "regularize"]
    assert advice.training_advice(facts.where("false")).count() == 0
    assert advice.generalization(facts).count() == 0


def test_settings(spark):
    assert jobs.configure(spark).conf.get("spark.sql.adaptive.enabled") == "true"
    df = series(spark, np.arange(10.0), days=2)
    assert sorted(r.gidx for r in jobs.first_rows(df, 3).collect()) == [0, 1, 2]


def test_facts_for_advice_read_the_source_once(spark, sf):
    """All plans but the one that fills the kept frame read that frame, not the table."""
    facts = jobs.training_facts(ticks(spark, sf), TICK_SIGNALS)
    leaves = facts._jdf.queryExecution().optimizedPlan().collectLeaves()
    names = [leaves.apply(k).nodeName() for k in range(leaves.size())]
    assert "InMemoryRelation" in names and not [n for n in names if "Relation" in n and n not in ("InMemoryRelation", "LocalRelation", "OneRowRelation")], names
    spark.catalog.clearCache()
