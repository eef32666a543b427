"""Queries on predictive power, correlation structure, distribution and stationarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlation as cor
from ..operators import distribution as dist
from ..operators import predictive as pre
from ..operators.frames import long_form
from ..operators.labels import signal_label_correlations as label_correlations
from ..sources.tables import TICK_SIGNALS, TRADE_SIGNALS, trades, vectors
from .base import Registry, corr_, r_, tail_, tick_frame, tick_long, ticks_sql
from .dynamics import _RANKS, auc_

query = Registry()

_LABEL_R = f"lr AS (SELECT signal, count(*) AS n, {corr_('value', 'label')} AS r FROM long GROUP BY signal)"


@query(
    ticks_sql(
        f"SELECT signal, n, {r_('coalesce(r, 0)')} AS correlation, {r_('coalesce(p, 1)', 5)} AS p_value, coalesce(p, 1) < 0.05 / count(*) OVER () AS is_significant FROM (SELECT *, {tail_('r', 'n')} AS p FROM lr)",
        _LABEL_R,
    )
)
def signal_label_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_correlations(tick_long(spark, sf_dir, gidx=False)).withColumn("p_value", F.round("p_value", 5))


@query(ticks_sql(f"SELECT signal, {r_('corr(rx, ry)')} AS spearman_r, {r_(auc_(1, False))} AS auc_up, {r_(auc_(-1, True))} AS auc_down FROM rk GROUP BY signal", _RANKS.format(of="long")))
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre.rank_metrics(pre.labelled(tick_long(spark, sf_dir, gidx=False)))


_TRADE_SQL = (
    "WITH trades AS (SELECT CASE l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN 1 ELSE 0 END AS label, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), long AS ("
    + " UNION ALL ".join(f"SELECT label, '{s}' AS signal, {s} AS value FROM trades" for s in TRADE_SIGNALS)
    + "), "
)


@query(_TRADE_SQL + _RANKS.format(of="long") + f" SELECT signal, {r_('corr(rx, ry)')} AS spearman_r, {r_(auc_(1, False))} AS auc_up, {r_(auc_(-1, True))} AS auc_down FROM rk GROUP BY signal")
def trade_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct values, so ties everywhere."""
    return pre.rank_metrics(pre.labelled(long_form(trades(spark, sf_dir), TRADE_SIGNALS)))


#: The nearest-neighbour estimate: the third neighbour's distance within the label, the rows of any label strictly nearer, digamma as harmonic sums.
_MI = """
c1 AS (SELECT signal, label, value, count(*) OVER (PARTITION BY signal, label) AS ny FROM long WHERE isfinite(value)),
c2 AS (SELECT signal, label, value, ny, list_sort([value - lag(value, 1) OVER o, value - lag(value, 2) OVER o, value - lag(value, 3) OVER o, lead(value, 1) OVER o - value, lead(value, 2) OVER o - value, lead(value, 3) OVER o - value], 'ASC', 'NULLS LAST')[least(3, ny - 1)] AS radius
  FROM c1 WHERE ny > 1 WINDOW o AS (PARTITION BY signal, label ORDER BY value)),
c3 AS (SELECT signal, label, value, ny, radius, count(*) AS n FROM c2 GROUP BY ALL),
c4 AS (SELECT signal, value AS other, count(*) AS many FROM c2 GROUP BY ALL),
c5 AS (SELECT c3.signal, c3.label, c3.value, any_value(ny) AS ny, any_value(n) AS n, sum(many) AS m FROM c3 JOIN c4 ON c4.signal = c3.signal AND CASE WHEN radius > 0 THEN other > value - radius AND other < value + radius ELSE other = value END GROUP BY c3.signal, c3.label, c3.value),
hs AS (SELECT i, coalesce(sum(CAST(1 AS DOUBLE) / (i - 1)) OVER (ORDER BY i), 0) - 0.57721566490153286 AS psi FROM range(1, 1 + (SELECT max(n) FROM (SELECT count(*) AS n FROM long GROUP BY signal))) t(i) WHERE i > 1 UNION ALL SELECT 1, -0.57721566490153286),
mi AS (SELECT c5.signal, greatest(0, any_value(ht.psi) + sum(n * (hk.psi - hy.psi - hm.psi)) / sum(n)) AS nats
  FROM c5 JOIN (SELECT signal, sum(n) AS total FROM c5 GROUP BY signal) t ON t.signal = c5.signal JOIN hs ht ON ht.i = t.total JOIN hs hk ON hk.i = least(3, ny - 1) JOIN hs hy ON hy.i = ny JOIN hs hm ON hm.i = m GROUP BY c5.signal)"""


@query(
    ticks_sql(
        f"""SELECT b.signal, n AS n_samples, {r_("r")} AS pearson_r, {r_("mean_up")} AS mean_up, {r_("mean_stable")} AS mean_stable, {r_("mean_down")} AS mean_down, {r_("rs")} AS spearman_r, {r_("auc_up")} AS auc_up, {r_("auc_down")} AS auc_down,
  {r_("nats", 5)} AS mi_nats, {r_("nats / ln(2)", 5)} AS mi_bits, {r_(tail_("r", "n"), 5)} AS pearson_p, {r_(tail_("rs", "n"), 5)} AS spearman_p, CASE WHEN b.signal <> 'k' THEN '-' END AS expected_sign, CASE WHEN b.signal <> 'k' THEN r < 0 END AS sign_consistent
FROM b JOIN rm ON rm.signal = b.signal JOIN mi ON mi.signal = b.signal""",
        f"b AS (SELECT signal, count(*) AS n, {corr_('value', 'label')} AS r, avg(value) FILTER (WHERE label = 1) AS mean_up, avg(value) FILTER (WHERE label = 0) AS mean_stable, avg(value) FILTER (WHERE label = -1) AS mean_down FROM long GROUP BY signal)",
        _RANKS.format(of="long"),
        f"rm AS (SELECT signal, corr(rx, ry) AS rs, {auc_(1, False)} AS auc_up, {auc_(-1, True)} AS auc_down FROM rk GROUP BY signal)",
        _MI,
    )
)
def signal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a signal's predictive power."""
    got = pre.signal_metrics(tick_long(spark, sf_dir, gidx=False), {"v": "-", "dv": "-"})
    return got.withColumns({c: F.round(c, 5) for c in ("mi_nats", "mi_bits", "pearson_p", "spearman_p")})


@query(ticks_sql(f"SELECT signal, {r_('nats', 5)} AS mi_nats, {r_('nats / ln(2)', 5)} AS mi_bits FROM mi", _MI))
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre.mutual_information(tick_long(spark, sf_dir, gidx=False)).withColumns({c: F.round(c, 5) for c in ("mi_nats", "mi_bits")})


@query(
    ticks_sql(
        f"SELECT signal, {r_('avg(value) FILTER (WHERE label = 1)')} AS mean_up, {r_('avg(value) FILTER (WHERE label = 0)')} AS mean_stable, {r_('avg(value) FILTER (WHERE label = -1)')} AS mean_down FROM long GROUP BY signal"
    )
)
def conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    return tick_long(spark, sf_dir, gidx=False).groupBy("signal").agg(mean(1).alias("mean_up"), mean(0).alias("mean_stable"), mean(-1).alias("mean_down"))


_BINS = f"""
SELECT signal, CAST(bin AS INTEGER) AS bin, count(*) AS n, {r_("avg(value)")} AS mean, {r_("min(value)")} AS min, {r_("max(value)")} AS max,
  {r_("count(*) FILTER (WHERE label = 1) / CAST(count(*) AS DOUBLE)")} AS p_up, {r_("count(*) FILTER (WHERE label = -1) / CAST(count(*) AS DOUBLE)")} AS p_down, {r_("count(*) FILTER (WHERE label = 0) / CAST(count(*) AS DOUBLE)")} AS p_stable
FROM (SELECT l.signal, l.label, l.value, (SELECT count(*) FROM ed WHERE ed.signal = l.signal AND ed.q < l.value AND ed.k > 1 AND ed.k < ed.n) AS bin FROM long l JOIN (SELECT DISTINCT signal FROM ed WHERE n > 1) USING (signal))
GROUP BY signal, bin"""
_EDGES = """ed AS (
  SELECT signal, q, row_number() OVER (PARTITION BY signal ORDER BY q) AS k, count(*) OVER (PARTITION BY signal) AS n
  FROM (SELECT DISTINCT signal, unnest(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q FROM long GROUP BY signal))"""


@query(ticks_sql(_BINS, _EDGES))
def binned_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre.binned_probabilities(tick_long(spark, sf_dir, gidx=False))


_TICK_PAIRS = [(i, j, a, b) for i, a in enumerate(TICK_SIGNALS) for j, b in enumerate(TICK_SIGNALS) if i <= j]
_MATRIX = "cm AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS signal_a, '{b}' AS signal_b, {corr_(a, b)} AS r FROM ticks" for i, j, a, b in _TICK_PAIRS) + ")"


@query(ticks_sql(f"SELECT i, j, signal_a, signal_b, {r_('r')} AS r FROM cm", _MATRIX))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cor.correlation_matrix(tick_frame(spark, sf_dir, gidx=False), TICK_SIGNALS)


@query(ticks_sql(f"SELECT i, j, signal_a, signal_b, {r_('r')} AS r FROM cm WHERE i < j AND abs(r) > 0.5", _MATRIX))
def redundant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cor.redundant_pairs(cor.correlation_matrix(tick_frame(spark, sf_dir, gidx=False), TICK_SIGNALS))


_VIF = "(1 - {a} * {a}) / (1 + 2 * rvk * rvd * rkd - rvk * rvk - rvd * rvd - rkd * rkd)"


@query(
    ticks_sql(
        f"""SELECT signal, {r_("vif")} AS vif, vif > 5 AS is_problematic, vif > 10 AS is_severe FROM (
  SELECT 'v' AS signal, {_VIF.format(a="rkd")} AS vif FROM c UNION ALL SELECT 'k', {_VIF.format(a="rvd")} FROM c UNION ALL SELECT 'dv', {_VIF.format(a="rvk")} FROM c)""",
        "c AS (SELECT corr(v, k) AS rvk, corr(v, dv) AS rvd, corr(k, dv) AS rkd FROM ticks)",
    )
)
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals: the inverse of a 3 x 3 matrix is closed form in SQL."""
    return cor.vif(tick_frame(spark, sf_dir, gidx=False), TICK_SIGNALS)


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all components of the embeddings."""
    df = vectors(spark, sf_dir)
    return cor.pca(df, [c for c in df.columns if c.startswith("e")])


@query(
    "WITH RECURSIVE "
    + ticks_sql("", _MATRIX)[5:].strip()
    + """, m AS (SELECT i, j, abs(r) AS r FROM cm WHERE i <> j UNION ALL SELECT j, i, abs(r) FROM cm WHERE i <> j),
nr AS (SELECT list(own ORDER BY i) AS near FROM (SELECT x.i, [x.i] || coalesce(list(m.j) FILTER (WHERE m.r > 0.5), []) AS own FROM (SELECT CAST(unnest(range(3)) AS INTEGER) AS i) x LEFT JOIN m ON m.i = x.i GROUP BY x.i)),
cl(cluster_id, own, free) AS (
  SELECT 0, list_filter([0, 1, 2], lambda x: list_contains(near[1], x)), list_filter([0, 1, 2], lambda x: NOT list_contains(near[1], x)) FROM nr
  UNION ALL SELECT cluster_id + 1, list_filter(free, lambda x: list_contains(near[free[1] + 1], x)), list_filter(free, lambda x: NOT list_contains(near[free[1] + 1], x)) FROM cl, nr WHERE len(free) > 0
), mem AS (SELECT cluster_id, unnest(own) AS k FROM cl)
SELECT cluster_id, list_transform(list_sort(own), lambda x: ['v', 'k', 'dv'][x + 1]) AS signals, """
    + r_("coalesce((SELECT avg(coalesce(m.r, 0)) FROM mem a JOIN mem b ON a.cluster_id = b.cluster_id AND a.k < b.k LEFT JOIN m ON m.i = a.k AND m.j = b.k WHERE a.cluster_id = cl.cluster_id), 1)")
    + " AS mean_within FROM cl"
)
def signal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tick_frame(spark, sf_dir, gidx=False)
    return cor.clusters(cor.correlation_matrix(df, TICK_SIGNALS), TICK_SIGNALS)


_GROUPS = f"""
SELECT signal, {r_("r")} AS pearson_r, {r_("abs(r)")} AS abs_r,
  CASE WHEN signal IN (SELECT CASE WHEN abs(a.r) <= abs(b.r) THEN a.signal ELSE b.signal END FROM cm JOIN lr a ON a.signal = cm.signal_a JOIN lr b ON b.signal = cm.signal_b WHERE cm.i < cm.j AND abs(cm.r) > 0.5) THEN 'redundant'
    WHEN abs(r) < 0.01 THEN 'low_priority' WHEN signal IN ('v', 'dv') AND r >= 0 THEN 'contrarian' WHEN abs(r) >= 0.05 THEN 'primary' ELSE 'moderate' END AS "group"
FROM lr"""


@query(ticks_sql(_GROUPS, _MATRIX, _LABEL_R))
def predictive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, long = tick_frame(spark, sf_dir, gidx=False), tick_long(spark, sf_dir, gidx=False)
    r = F.col("pearson_r")
    metrics = label_correlations(long).select("signal", F.col("correlation").alias("pearson_r")).withColumn("sign_consistent", F.when(F.col("signal").isin("v", "dv"), r < 0))
    return pre.predictive_groups(metrics, cor.correlation_matrix(df, TICK_SIGNALS))


_MOMENTS = """mo AS (
  SELECT signal, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median FROM long GROUP BY signal)"""


@query(
    ticks_sql(
        f"""SELECT mo.signal, mo.n, {r_("mo.mean")} AS mean, {r_("mo.std")} AS std, {r_("mo.min")} AS min, {r_("mo.max")} AS max, {r_("avg(pow((l.value - mo.mean) / mo.std, 3))")} AS skewness, {r_("avg(pow((l.value - mo.mean) / mo.std, 4)) - 3")} AS kurtosis,
  {r_("mo.median")} AS median, {r_("100 * count(*) FILTER (WHERE abs(l.value - mo.mean) > 3 * mo.std) / CAST(mo.n AS DOUBLE)")} AS pct_outliers
FROM mo JOIN long l ON l.signal = mo.signal GROUP BY mo.signal, mo.n, mo.mean, mo.std, mo.min, mo.max, mo.median""",
        _MOMENTS,
    )
)
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.distribution_stats(tick_long(spark, sf_dir, gidx=False)).drop("k2", "p_normal")


_SCORES = """
a1 AS (SELECT signal, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM long GROUP BY signal),
a2 AS (SELECT l.signal, any_value(n) AS n, avg(pow((value - mean) / sd, 3)) AS s, avg(pow((value - mean) / sd, 4)) AS k FROM long l JOIN a1 ON a1.signal = l.signal WHERE n >= 20 AND sd > 1e-10 GROUP BY l.signal),
a3 AS (SELECT *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
  (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM a2),
a4 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM a3),
a5 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, 1 + x * sqrt(2 / (a - 4)) AS d FROM a4),
a6 AS (SELECT *, (1 - 2 / (9 * a) - sign(d) * pow((1 - 2 / a) / abs(d), CAST(1 AS DOUBLE) / 3)) / sqrt(2 / (9 * a)) AS z2 FROM a5)"""


@query(ticks_sql(f"SELECT signal, {r_('z1 * z1 + z2 * z2')} AS k2, {r_('exp(-(z1 * z1 + z2 * z2) / 2)')} AS p_normal FROM a6", _SCORES))
def normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.normality(tick_long(spark, sf_dir, gidx=False))


@query()
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.stationarity(tick_long(spark, sf_dir))


_WINDOW, _MANY = 100, 10


@query(
    ticks_sql(
        f"""SELECT signal, n_windows, {r_("md")} AS mean_drift, {r_("sd")} AS std_drift, {r_("lo")} AS min_mean, {r_("hi")} AS max_mean, {r_("hi - lo")} AS mean_range, hi - lo < 0.5 * dev AS is_mean_stable, abs(sd) < 0.3 * dev AS is_std_stable
FROM (SELECT e.signal, count(*) AS n_windows, max_by(m, w) - min_by(m, w) AS md, max_by(s, w) - min_by(s, w) AS sd, min(m) AS lo, max(m) AS hi, any_value(wh.dev) AS dev FROM e2 e JOIN wh ON wh.signal = e.signal GROUP BY e.signal)""",
        "wh AS (SELECT signal, count(*) AS n, stddev_pop(value) AS dev FROM long GROUP BY signal)",
        f"ws AS (SELECT signal, unnest(range(0, n - {_WINDOW}, greatest(1, (n - {_WINDOW}) // {_MANY}))) AS a FROM wh WHERE n >= {2 * _WINDOW})",
        f"e2 AS (SELECT ws.signal, ws.a AS w, avg(l.value) AS m, stddev_pop(l.value) AS s FROM ws JOIN long l ON l.signal = ws.signal AND l.gidx >= ws.a AND l.gidx < ws.a + {_WINDOW} GROUP BY ws.signal, ws.a)",
    )
)
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.rolling_stats(tick_long(spark, sf_dir), _WINDOW, _MANY)


@query(
    f"""WITH b AS (SELECT l.quality AS label, CAST(d.n_chars AS DOUBLE) AS value, 'n_chars' AS signal FROM labels l JOIN documents d USING (doc_id)),
{_RANKS.format(of="b")}
SELECT signal, {r_("corr(rx, ry)")} AS spearman_r, {r_(auc_(1, False))} AS auc_up FROM rk GROUP BY signal"""
)
def document_length_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a text's length tells its quality label: a binary target."""
    both = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    long = both.select(F.lit("n_chars").alias("signal"), F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("value"))
    return pre.rank_metrics(pre.labelled(long)).select("signal", "spearman_r", "auc_up")
