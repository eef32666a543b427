"""Queries on what follows from the analyses: assessment over days, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import jobs
from ..operators import advice, regimes
from ..sources.tables import TICK_SIGNALS
from .base import Registry, r_, tick_frame, tick_long, ticks_sql
from .dynamics import _ABS_R, _BY_REGIME, _PER_DAY, _REGIME

query = Registry()

_FOLDS = """
pf AS (SELECT date, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM ticks GROUP BY date),
f AS (SELECT date, train_days, s / n AS mu, sqrt(ss / n - (s / n) * (s / n)) AS sd FROM (SELECT date, count(*) OVER w AS train_days, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM pf WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
wf AS (SELECT l.date, avg(CASE WHEN (CASE WHEN l.v > mu + sd / 2 THEN 1 WHEN l.v < mu - sd / 2 THEN -1 ELSE 0 END) = l.label THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy FROM ticks l JOIN f USING (date) WHERE f.train_days >= 3 GROUP BY l.date)"""
_STABILITY = """
st AS (
  SELECT signal, CASE WHEN abs(mr) > 1e-10 THEN abs(mr) / (sr + 1e-10) ELSE 0 END AS score, signs, zero, flips FROM (
    SELECT signal, avg(r) AS mr, stddev_pop(r) AS sr, count(DISTINCT sign(r)) AS signs, count(*) FILTER (WHERE r = 0 AND k <= n // 2 + 1) AS zero, bool_or(r > 0) AND bool_or(r < 0) AS flips
    FROM (SELECT signal, r, row_number() OVER (PARTITION BY signal ORDER BY date) AS k, count(*) OVER (PARTITION BY signal) AS n FROM pd) GROUP BY signal)),
a AS (SELECT (SELECT count(DISTINCT date) FROM pd) AS n_days, (SELECT avg(score) FROM st) AS s, (SELECT coalesce(avg(accuracy), CAST(0 AS DOUBLE)) FROM wf) AS a)"""
_FIRST = "(SELECT array_to_string(list(signal ORDER BY signal)[1:3], ', ') FROM {of} WHERE {holds})"
_UNSTABLE = "NOT (score > 1 AND signs <= 2 AND zero = 0)"


@query(
    ticks_sql(
        f"SELECT n_days, {r_('s', 4)} AS overall_stability_score, {r_('a')} AS walk_forward_avg_accuracy, CASE WHEN s > 2 AND a > 0.35 THEN 'GOOD' WHEN s > 1 OR a > 0.35 THEN 'MODERATE' ELSE 'POOR' END AS generalization_assessment FROM a WHERE n_days >= 3",
        _PER_DAY,
        _FOLDS,
        _STABILITY,
    )
)
def generalization_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = advice.generalization(advice.generalization_facts(tick_long(spark, sf_dir, gidx=False), "v"))
    return got.selectExpr("n_days", "round(overall_stability_score, 4) AS overall_stability_score", "walk_forward_avg_accuracy", "generalization_assessment")


def _rules(topic: str, *rules: tuple[str, str, str], of: str) -> str:
    return " UNION ALL ".join(f"SELECT '{topic}' AS topic, '{code}' AS code, {detail} AS detail FROM {of} WHERE {holds}" for code, holds, detail in rules)


@query(
    ticks_sql(
        _rules(
            "generalization",
            ("normalize_by_day", "n_days >= 3 AND s < 1.5", "'signals change from day to day; normalize by day or adapt the model'"),
            ("unstable_signals", f"n_days >= 3 AND (SELECT count(*) FROM st WHERE {_UNSTABLE}) > 0", _FIRST.format(of="st", holds=_UNSTABLE)),
            ("low_walk_forward_accuracy", "n_days >= 3 AND a < 0.35", "'a threshold on one signal does not predict'"),
            ("flipping_signals", "n_days >= 3 AND (SELECT count(*) FROM st WHERE flips) > 0", _FIRST.format(of="st", holds="flips")),
            ("few_days", "n_days >= 3 AND n_days < 10", "n_days || ' days are few'"),
            of="a",
        ),
        _PER_DAY,
        _FOLDS,
        _STABILITY,
    )
)
def generalization_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.generalization_advice(advice.generalization_facts(tick_long(spark, sf_dir, gidx=False), "v"))


@query(
    ticks_sql(
        _rules(
            "training",
            ("regime_matters", "ratio > 2", "'signals predict best in ' || best"),
            ("regime_stable", "ratio <= 2", "'signals predict alike in all regimes'"),
            ("regime_dependent_signals", "(SELECT count(*) FROM se WHERE span > 0.01) > 0", _FIRST.format(of="se", holds="span > 0.01")),
            ("label_deviation_varies", "deviation > 1.5", "'labels vary most in ' || wild"),
            ("closed_samples", "closed > 0", "closed || ' samples are outside market hours'"),
            of="ra",
        ),
        _BY_REGIME,
        _ABS_R,
        "im AS (SELECT regime, avg(a) AS i FROM ar GROUP BY regime)",
        "se AS (SELECT signal, max(a) - min(a) AS span FROM ar GROUP BY signal)",
        "ls AS (SELECT regime, stddev_pop(label) AS d, count(label) AS n FROM ticks GROUP BY regime)",
        f"""ra AS (SELECT (SELECT max(i) / (min(i) + 1e-10) FROM im) AS ratio, (SELECT {_REGIME} FROM im ORDER BY i DESC, regime LIMIT 1) AS best,
  (SELECT max(d) / (min(d) + 1e-10) FROM ls) AS deviation, (SELECT {_REGIME} FROM ls ORDER BY d DESC, regime LIMIT 1) AS wild, (SELECT coalesce(sum(n), 0) FROM ls WHERE regime = 4) AS closed)""",
    )
)
def regime_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = regimes.regime_correlations(tick_long(spark, sf_dir, gidx=False))
    return advice.regime_advice(regimes.regime_stats(tick_frame(spark, sf_dir, gidx=False)), regimes.seasonality(by), regimes.regime_importance(by))


@query()
def training_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the facts of all stages; components are beyond SQL."""
    return advice.training_advice(jobs.training_facts(tick_frame(spark, sf_dir), TICK_SIGNALS))
