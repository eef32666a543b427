"""Queries on label dynamics, temporal dynamics, stability over days and intraday regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generalization as gen
from ..operators import labels as lab
from ..operators import regimes as reg
from ..operators import temporal as tem
from ..operators.distribution import running_day_moments as moments
from ..sources.tables import TICK_SIGNALS
from .base import Registry, corr_, pct_, r_, tail_, tick_frame, tick_long, ticks_sql

query = Registry()

_STEPS = "st AS (SELECT label AS to_label, lag(label) OVER ({over} ORDER BY gidx) AS from_label FROM ticks)"
_TRANSITIONS = f"""
SELECT a.label AS from_label, b.label AS to_label, coalesce(t.n, 0) AS n,
  {r_("coalesce(t.n / CAST(nullif(sum(t.n) OVER (PARTITION BY a.label), 0) AS DOUBLE), 0)")} AS probability, {r_("a.share")} AS share,
  CASE WHEN a.label = b.label THEN {r_("coalesce(t.n / CAST(nullif(sum(t.n) OVER (PARTITION BY a.label), 0) AS DOUBLE), 0) - a.share")} END AS persistence
FROM sh a CROSS JOIN sh b LEFT JOIN (SELECT from_label, to_label, count(*) AS n FROM st WHERE from_label IS NOT NULL GROUP BY ALL) t ON t.from_label = a.label AND t.to_label = b.label"""
_SHARES = "sh AS (SELECT label, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM ticks GROUP BY label)"


@query(ticks_sql(_TRANSITIONS, _STEPS.format(over="PARTITION BY date"), _SHARES))
def transitions_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.transitions(tick_frame(spark, sf_dir))


@query(ticks_sql(_TRANSITIONS, _STEPS.format(over=""), _SHARES))
def transitions_across_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.transitions(tick_frame(spark, sf_dir), across_days=True)


_LAGS = 20


def _acf(of: str) -> tuple[str, ...]:
    """Common table acf (signal, lag, acf, confidence) of rows (signal, gidx, value)."""
    return (
        f"src AS ({of})",
        "st AS (SELECT signal, avg(value) AS mean, var_pop(value) AS var, count(*) AS n FROM src GROUP BY signal)",
        "c AS (SELECT signal, gidx, value - mean AS x FROM src JOIN st USING (signal))",
        f"""acf AS (
  SELECT p.signal, p.lag, p.s / st.var AS acf, 1.96 / sqrt(st.n) AS confidence FROM (
    SELECT a.signal, CAST(t.k AS INTEGER) AS lag, avg(a.x * b.x) AS s FROM c a CROSS JOIN range({_LAGS + 1}) t(k) JOIN c b ON b.signal = a.signal AND b.gidx = a.gidx + t.k GROUP BY a.signal, t.k
  ) p JOIN st USING (signal))""",
    )


_LABEL_SOURCE = "SELECT 'label' AS signal, gidx, CAST(label AS DOUBLE) AS value FROM ticks"
_ALL_ACF = f"SELECT signal, lag, {r_('acf')} AS acf, {r_('confidence')} AS confidence FROM acf"


@query(ticks_sql(_ALL_ACF, *_acf(_LABEL_SOURCE)))
def label_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = tick_frame(spark, sf_dir).select(F.lit("label").alias("signal"), "gidx", F.col("label").cast("double").alias("value"))
    return lab.autocorrelation(series, _LAGS)


@query(ticks_sql(_ALL_ACF, *_acf("SELECT signal, gidx, value FROM long")))
def signal_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.autocorrelation(tick_long(spark, sf_dir), _LAGS)


@query(
    ticks_sql(
        f"""SELECT signal, half_life, {r_("CASE WHEN one > 0 AND one < 1 THEN -ln(one) ELSE 0 END")} AS decay_rate,
  CASE WHEN one > 0.1 THEN 'strong' WHEN one > confidence THEN 'weak' WHEN one < -confidence THEN 'reverting' ELSE 'none' END AS reading,
  CASE WHEN half_life <= 5 THEN 'very short' WHEN half_life <= 20 THEN 'short' WHEN half_life <= 50 THEN 'medium' ELSE 'long' END AS persistence
FROM (SELECT signal, coalesce(min(lag) FILTER (WHERE acf < 0.5), max(lag)) AS half_life, max(acf) FILTER (WHERE lag = 1) AS one, max(confidence) AS confidence FROM acf GROUP BY signal)""",
        *_acf("SELECT signal, gidx, value FROM long"),
    )
)
def signal_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tem.persistence(tick_long(spark, sf_dir), _LAGS)


_MAX_LAG = 10
_PAIRS = [(a, b) for i, a in enumerate(TICK_SIGNALS) for b in TICK_SIGNALS[i + 1 :]]
_CROSS = (
    "cc AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS signal_a, '{b}' AS signal_b, {TICK_SIGNALS.index(a)} AS i, {TICK_SIGNALS.index(b)} AS j, CAST(t.k AS INTEGER) AS lag, coalesce({corr_('x.' + a, 'y.' + b)}, 0) AS r "
        f"FROM ticks x CROSS JOIN range(-{_MAX_LAG}, {_MAX_LAG + 1}) t(k) JOIN ticks y ON y.gidx = x.gidx + t.k GROUP BY t.k"
        for a, b in _PAIRS
    )
    + ")"
)


@query(ticks_sql(f"SELECT signal_a, signal_b, lag, {r_('r')} AS r FROM cc", _CROSS))
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tem.cross_correlation(tick_frame(spark, sf_dir), TICK_SIGNALS, _MAX_LAG).select("signal_a", "signal_b", "lag", "r")


@query(
    ticks_sql(
        f"""SELECT CASE WHEN lag > 0 THEN signal_a ELSE signal_b END AS leader, CASE WHEN lag > 0 THEN signal_b ELSE signal_a END AS follower, abs(lag) AS optimal_lag, {r_("r")} AS max_correlation, abs(r) > 0.2 AS is_significant
FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY round(abs(r), 12) DESC, lag) AS k FROM cc) WHERE k = 1 AND abs(r) >= 0.01""",
        _CROSS,
    )
)
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tem.lead_lag(tem.cross_correlation(tick_frame(spark, sf_dir), TICK_SIGNALS, _MAX_LAG), 0.01)


_DECAY = f"""dk AS (
  SELECT y.signal, CAST(t.k AS INTEGER) AS lag, count(*) AS n, CASE WHEN count(*) >= 100 THEN coalesce({corr_("x.value", "y.label")}, 0) ELSE 0 END AS r
  FROM long y CROSS JOIN (SELECT unnest({tem.DECAY_LAGS}) AS k) t JOIN long x ON x.signal = y.signal AND x.gidx = y.gidx - t.k GROUP BY y.signal, t.k)"""


@query(ticks_sql(f"SELECT signal, lag, n, {r_('r')} AS r FROM dk", _DECAY))
def predictive_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tem.predictive_decay(tick_long(spark, sf_dir))


@query(
    ticks_sql(
        f"""SELECT b.signal, b.lag AS optimal_lag, {r_("b.r")} AS max_correlation, coalesce((SELECT min(lag) FROM dk WHERE dk.signal = b.signal AND abs(dk.r) < abs(b.r) / 2), (SELECT max(lag) FROM dk WHERE dk.signal = b.signal)) AS half_life
FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY round(abs(r), 12) DESC, lag) AS k FROM dk) b WHERE k = 1""",
        _DECAY,
    )
)
def decay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tem.decay_summary(tem.predictive_decay(tick_long(spark, sf_dir)))


_RANKS = """rk AS (
  SELECT signal, label, value, rank() OVER (PARTITION BY signal ORDER BY value) + (count(*) OVER (PARTITION BY signal, value) - 1) / CAST(2 AS DOUBLE) AS rx,
    rank() OVER (PARTITION BY signal ORDER BY label) + (count(*) OVER (PARTITION BY signal, label) - 1) / CAST(2 AS DOUBLE) AS ry FROM {of})"""


def auc_(label: int, turned: bool) -> str:
    m = f"CAST(count(*) FILTER (WHERE label = {label}) AS DOUBLE)"
    a = f"(sum(rx) FILTER (WHERE label = {label}) - {m} * ({m} + 1) / 2) / nullif({m} * (count(*) - {m}), 0)"
    return f"coalesce({'1 - ' if turned else ''}({a}), 0.5)"


@query(
    ticks_sql(
        f"""SELECT signal, {r_("lr")} AS level_r, {r_("cr")} AS change_r, {r_("la")} AS level_auc, {r_("ca")} AS change_auc,
  CASE WHEN n < 100 THEN 'insufficient_data' WHEN abs(lr) + la - 0.5 > CAST(1.2 AS DOUBLE) * (abs(cr) + ca - 0.5) THEN 'level' WHEN abs(cr) + ca - 0.5 > CAST(1.2 AS DOUBLE) * (abs(lr) + la - 0.5) THEN 'change' ELSE 'both' END AS recommendation
FROM (SELECT split_part(signal, '/', 1) AS signal, max(n) AS n, max(r) FILTER (WHERE signal LIKE '%/level') AS lr, max(r) FILTER (WHERE signal LIKE '%/change') AS cr,
  max(auc) FILTER (WHERE signal LIKE '%/level') AS la, max(auc) FILTER (WHERE signal LIKE '%/change') AS ca
  FROM (SELECT signal, count(*) AS n, coalesce({corr_("value", "label")}, 0) AS r, {auc_(1, False)} AS auc FROM rk GROUP BY signal) GROUP BY 1)""",
        "ch AS (SELECT signal, gidx, label, value, value - coalesce(lag(value, 10) OVER w, first_value(value) OVER w) AS change FROM long WINDOW w AS (PARTITION BY signal ORDER BY gidx))",
        "lc AS (SELECT signal || '/level' AS signal, label, value FROM ch UNION ALL SELECT signal || '/change', label, change FROM ch)",
        _RANKS.format(of="lc"),
    )
)
def level_vs_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tem.level_vs_change(tick_long(spark, sf_dir))


_PER_DAY = f"""pd AS (
  SELECT signal, date, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, CASE WHEN count(*) > 10 THEN coalesce({corr_("value", "label")}, 0) ELSE 0 END AS r FROM long GROUP BY signal, date)"""


@query(ticks_sql(f"SELECT signal, date, n, {r_('mean')} AS mean, {r_('std')} AS std, {r_('r')} AS r FROM pd", _PER_DAY))
def signal_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.per_day(tick_long(spark, sf_dir, gidx=False))


@query(
    ticks_sql(
        f"""SELECT signal, n_days, {r_("mm")} AS mean_of_means, {r_("sm")} AS std_of_means, {r_("mr")} AS mean_of_correlations, {r_("sr")} AS std_of_correlations, {r_("score", 4)} AS stability_score,
  score > 1 AND signs <= 2 AND zero = 0 AS is_stable
FROM (SELECT *, CASE WHEN abs(mr) > 1e-10 THEN abs(mr) / (sr + 1e-10) ELSE 0 END AS score FROM (
  SELECT signal, count(*) AS n_days, avg(mean) AS mm, stddev_pop(mean) AS sm, avg(r) AS mr, stddev_pop(r) AS sr, count(DISTINCT sign(r)) AS signs, count(*) FILTER (WHERE r = 0 AND k <= n // 2 + 1) AS zero
  FROM (SELECT signal, mean, r, row_number() OVER (PARTITION BY signal ORDER BY date) AS k, count(*) OVER (PARTITION BY signal) AS n FROM pd) GROUP BY signal))""",
        _PER_DAY,
    )
)
def signal_day_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gen.day_stability(gen.per_day(tick_long(spark, sf_dir, gidx=False)))
    return got.withColumn("stability_score", F.round("stability_score", 4))


@query(
    ticks_sql(
        f"""SELECT l.date AS test_day, max(f.train_days) AS train_days, CAST(max(f.train_n) AS BIGINT) AS train_n, count(*) AS test_n,
  {r_("avg(CASE WHEN (CASE WHEN l.v > mu + sd / 2 THEN 1 WHEN l.v < mu - sd / 2 THEN -1 ELSE 0 END) = l.label THEN CAST(1 AS DOUBLE) ELSE 0 END)")} AS accuracy, {r_("coalesce(" + corr_("l.v", "l.label") + ", 0)")} AS test_r
FROM ticks l JOIN f USING (date) WHERE f.train_days >= 3 GROUP BY l.date""",
        "pd AS (SELECT date, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM ticks GROUP BY date)",
        "f AS (SELECT date, train_days, train_n, s / train_n AS mu, sqrt(ss / train_n - (s / train_n) * (s / train_n)) AS sd FROM (SELECT date, count(*) OVER w AS train_days, sum(n) OVER w AS train_n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM pd WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))",
    )
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.walk_forward(tick_long(spark, sf_dir, gidx=False), "v")


@query(
    ticks_sql(
        f"""SELECT signal, date, CAST(sum(n) OVER w AS BIGINT) AS n, {r_("sum(s) OVER w / sum(n) OVER w")} AS mean, {r_("sqrt(greatest(sum(ss) OVER w / sum(n) OVER w - pow(sum(s) OVER w / sum(n) OVER w, 2), 0))")} AS std
FROM (SELECT signal, date, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM long GROUP BY signal, date) WINDOW w AS (PARTITION BY signal ORDER BY date)"""
    )
)
def running_day_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(tick_long(spark, sf_dir, gidx=False))


_SHARE = {k: r_(pct_(f"count(*) FILTER (WHERE label = {v})", "count(*)")) for k, v in (("up", 1), ("down", -1), ("stable", 0))}
_REGIME = "CASE regime WHEN 0 THEN 'OPEN' WHEN 1 THEN 'EARLY' WHEN 2 THEN 'MIDDAY' WHEN 3 THEN 'CLOSE' ELSE 'CLOSED' END"


@query(ticks_sql(f"SELECT regime, count(*) AS n_samples, {_SHARE['up']} AS up_pct, {_SHARE['down']} AS down_pct, {_SHARE['stable']} AS stable_pct, {r_('coalesce(' + corr_('v', 'label') + ', 0)')} AS correlation FROM ticks GROUP BY regime HAVING count(*) >= 100"))
def regime_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.regime_label_stats(tick_frame(spark, sf_dir, gidx=False), "v")


@query(
    ticks_sql(
        f"SELECT regime, count(label) AS n_samples, {r_('avg(label)')} AS label_mean, {r_('stddev_pop(label)')} AS label_std, {_SHARE['down']} AS down_pct, {_SHARE['stable']} AS stable_pct, {_SHARE['up']} AS up_pct, {_REGIME} AS regime_name FROM ticks GROUP BY regime"
    )
)
def regime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.regime_stats(tick_frame(spark, sf_dir, gidx=False))


_BY_REGIME = f"rc AS (SELECT signal, regime, count(*) AS n, {corr_('value', 'label')} AS r FROM long GROUP BY signal, regime)"


@query(
    ticks_sql(
        f"""SELECT signal, regime, n AS n_samples, {r_("CASE WHEN r IS NOT NULL AND n >= 3 THEN r ELSE 0 END")} AS correlation, {r_("CASE WHEN r IS NOT NULL AND n >= 3 THEN p ELSE 1 END", 5)} AS p_value,
  r IS NOT NULL AND n >= 3 AND p < 0.01 AS is_significant, r IS NOT NULL AND n >= 3 AND (signal <> 'dv' OR r < 0) AS sign_consistent FROM (SELECT *, {tail_("r", "n")} AS p FROM rc)""",
        _BY_REGIME,
    ),
)
def regime_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.regime_correlations(tick_long(spark, sf_dir, gidx=False), {"dv": "-"}).withColumn("p_value", F.round("p_value", 5))


_ABS_R = "ar AS (SELECT signal, regime, CASE WHEN r IS NOT NULL AND n >= 3 THEN abs(r) ELSE 0 END AS a FROM rc)"


@query(
    ticks_sql(
        f"""SELECT signal, {r_("hi - lo")} AS correlation_range, most AS most_predictive_regime, least AS least_predictive_regime, hi - lo > 0.01 AS is_regime_dependent,
  {r_("CASE WHEN lo > 1e-10 THEN hi / lo WHEN hi > 1e-10 THEN CAST('inf' AS DOUBLE) ELSE 1 END", 4)} AS regime_impact_ratio
FROM (SELECT signal, max(a) AS hi, min(a) AS lo, list(regime ORDER BY a DESC, regime)[1] AS most, list(regime ORDER BY a, regime)[1] AS least FROM ar GROUP BY signal)""",
        _BY_REGIME,
        _ABS_R,
    )
)
def signal_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.seasonality(reg.regime_correlations(tick_long(spark, sf_dir, gidx=False))).withColumn("regime_impact_ratio", F.round("regime_impact_ratio", 4))


@query(ticks_sql(f"SELECT regime, {r_('avg(a)')} AS importance FROM ar GROUP BY regime", _BY_REGIME, _ABS_R))
def regime_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.regime_importance(reg.regime_correlations(tick_long(spark, sf_dir, gidx=False)))
