"""Queries on shapes, data quality, label distributions and column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as lab
from ..operators import quality as q
from ..operators.frames import aligned, long_form
from ..sources.tables import TRADE_SIGNALS, trades
from .base import Registry, pct_, r_, tick_frame, tick_long, ticks_sql

query = Registry()

_DIST = f"""
SELECT {{by}}total, down_count, stable_count, up_count,
  {r_(pct_("down_count", "total"))} AS down_pct, {r_(pct_("stable_count", "total"))} AS stable_pct, {r_(pct_("up_count", "total"))} AS up_pct,
  {r_("hi / CAST(greatest(lo, 1) AS DOUBLE)")} AS imbalance_ratio, hi / CAST(greatest(lo, 1) AS DOUBLE) < 1.5 AS is_balanced,
  CASE hi WHEN down_count THEN 'Down' WHEN stable_count THEN 'Stable' ELSE 'Up' END AS majority_class,
  CASE lo WHEN down_count THEN 'Down' WHEN stable_count THEN 'Stable' ELSE 'Up' END AS minority_class
FROM (SELECT *, greatest(down_count, stable_count, up_count) AS hi, least(down_count, stable_count, up_count) AS lo FROM c)"""
_COUNTS = "c AS (SELECT {by}count(*) AS total, count(*) FILTER (WHERE label = -1) AS down_count, count(*) FILTER (WHERE label = 0) AS stable_count, count(*) FILTER (WHERE label = 1) AS up_count FROM {of} {group})"
_TRADES = """
trades AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS date, CASE l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN 1 ELSE 0 END AS label,
    l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
)"""
_TRADE_LONG = "long AS (" + " UNION ALL ".join(f"SELECT date, label, '{s}' AS signal, {s} AS value FROM trades" for s in TRADE_SIGNALS) + ")"


@query(ticks_sql(_DIST.format(by=""), _COUNTS.format(by="", of="ticks", group="")))
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.label_distribution(tick_frame(spark, sf_dir, gidx=False))


@query("WITH " + _TRADES.strip() + ", " + _COUNTS.format(by="date, ", of="trades", group="GROUP BY date") + _DIST.format(by="date, "))
def trade_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.label_distribution(trades(spark, sf_dir), ("date",))


_STATS = f"SELECT {{by}}signal, count(value) AS n, {r_('avg(value)')} AS mean, {r_('stddev_pop(value)')} AS std, {r_('min(value)')} AS min, {r_('max(value)')} AS max FROM long GROUP BY {{by}}signal"


@query(ticks_sql(_STATS.format(by="")))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.column_stats(tick_long(spark, sf_dir, gidx=False)).select("signal", "n", "mean", "std", "min", "max")


@query(ticks_sql(_STATS.format(by="regime, ")))
def column_stats_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.column_stats(tick_long(spark, sf_dir, gidx=False), ("regime", "signal"))


@query(ticks_sql(_STATS.format(by="")))
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days' statistics combined: equal to the statistics of the whole."""
    return q.merge_stats(q.column_stats(tick_long(spark, sf_dir, gidx=False), ("date", "signal")))


@query(f"WITH {_TRADES.strip()}, {_TRADE_LONG} {_STATS.format(by='')}")
def trade_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.column_stats(long_form(trades(spark, sf_dir), TRADE_SIGNALS))


@query(
    f"""WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS signal, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
e AS (SELECT signal, count(value) AS n, count(*) FILTER (WHERE isnan(value)) AS nan, count(*) FILTER (WHERE isinf(value)) AS inf FROM v GROUP BY signal),
o AS (SELECT CAST(sum(n) AS BIGINT) AS total_values, CAST(sum(nan) AS BIGINT) AS nan_count, CAST(sum(inf) AS BIGINT) AS inf_count, count(*) FILTER (WHERE nan > 0) AS n_columns_with_nan, count(*) FILTER (WHERE inf > 0) AS n_columns_with_inf FROM e)
SELECT total_values, total_values - nan_count - inf_count AS finite_count, nan_count, inf_count, {r_(pct_("total_values - nan_count - inf_count", "total_values"))} AS pct_finite,
  {r_(pct_("nan_count", "total_values"))} AS pct_nan, {r_(pct_("inf_count", "total_values"))} AS pct_inf, n_columns_with_nan, n_columns_with_inf, nan_count + inf_count = 0 AS is_clean FROM o"""
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every component of the embeddings."""
    long = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.posexplode("embedding").alias("signal", "value")).withColumn("value", F.col("value").cast("double"))
    got = q.data_quality(long)
    many = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return got.select("total_values", "finite_count", "nan_count", "inf_count", "pct_finite", "pct_nan", "pct_inf", many("columns_with_nan"), many("columns_with_inf"), "is_clean")


@query(
    ticks_sql(
        f"""SELECT m.signal, m.n, {r_("m.mean")} AS mean, {r_("m.std")} AS std, {r_("m.min")} AS min, {r_("m.max")} AS max, {r_("m.q25")} AS q25, {r_("m.median")} AS median, {r_("m.q75")} AS q75, m.n_unique,
  {r_(pct_("count(*) FILTER (WHERE m.std > 0 AND abs(l.value - m.mean) > 4 * m.std)", "m.n"))} AS pct_outliers
FROM m JOIN long l ON l.signal = m.signal GROUP BY m.signal, m.n, m.mean, m.std, m.min, m.max, m.q25, m.median, m.q75, m.n_unique""",
        "m AS (SELECT signal, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, count(DISTINCT value) AS n_unique FROM long GROUP BY signal)",
    )
)
def signal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.signal_statistics(tick_long(spark, sf_dir, gidx=False)).select("signal", "n", "mean", "std", "min", "max", "q25", "median", "q75", "n_unique", "pct_outliers")


_CATEGORICAL = """
SELECT '{name}' AS name, array_to_string(list(CAST(CAST({name} AS INTEGER) AS VARCHAR) ORDER BY {name}), ',') AS unique_values, array_to_string(list(CAST(n AS VARCHAR) ORDER BY {name}), ',') AS value_counts,
  {valid} AS is_valid FROM (SELECT {name}, count(*) AS n FROM ticks GROUP BY {name})"""


@query(
    ticks_sql(
        " UNION ALL ".join(
            [
                _CATEGORICAL.format(name="regime", valid="bool_and(regime IN (0, 1, 2, 3, 4))"),
                _CATEGORICAL.format(name="label", valid="bool_and(label IN (0, 1))"),
                _CATEGORICAL.format(name="k", valid="true"),
            ]
        )
    )
)
def categorical_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes as expected, labels with an unexpected value, a feature without expectations."""
    df = tick_frame(spark, sf_dir, gidx=False)
    got = q.categorical(df, "regime", [0, 1, 2, 3, 4]).unionByName(q.categorical(df, "label", [0, 1])).unionByName(q.categorical(df, "k", None))
    whole = lambda c, t: F.array_join(F.transform(c, lambda x: x.cast(t).cast("string")), ",").alias(c)
    return got.select("name", whole("unique_values", "int"), whole("value_counts", "long"), "is_valid")


_SPLIT_SQL = "t AS (SELECT *, CASE WHEN day(CAST(date AS DATE)) <= 20 THEN 'train' WHEN day(CAST(date AS DATE)) <= 25 THEN 'val' ELSE 'test' END AS split FROM ticks)"


def _split(df: DataFrame) -> DataFrame:
    day = F.dayofmonth(F.to_date("date"))
    return df.withColumn("split", F.when(day <= 20, "train").when(day <= 25, "val").otherwise("test"))


@query(ticks_sql("SELECT split, count(DISTINCT date) AS n_days, count(*) AS n_samples, count(label) AS n_labels, min(date) AS first_date, max(date) AS last_date FROM t GROUP BY ROLLUP (split)", _SPLIT_SQL))
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.overview(_split(tick_frame(spark, sf_dir, gidx=False)))


@query(ticks_sql(f"SELECT split, count(*) AS n_samples, count(*) * 392 AS bytes, {r_('count(*) * 392 / CAST(1048576 AS DOUBLE)')} AS mb, {r_('count(*) * 392 / CAST(1073741824 AS DOUBLE)')} AS gb FROM t GROUP BY ROLLUP (split)", _SPLIT_SQL))
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.memory_estimate(_split(tick_frame(spark, sf_dir, gidx=False)))


@query(
    f"""WITH s AS (SELECT 'train' AS split, CAST(label AS VARCHAR) AS date, len(embedding) AS w, vec_id FROM embeddings),
a AS (SELECT split, date, count(*) AS n_samples, max(w) AS n_features, min(w) AS lo FROM s GROUP BY split, date), b AS (SELECT split, date, count(*) AS n_labels FROM s WHERE vec_id % 10 = 0 GROUP BY split, date)
SELECT a.split, a.date, n_samples, coalesce(n_labels, 0) AS n_labels, CAST(n_features AS INTEGER) AS n_features, n_features = 64 AND lo = 64 AS feature_dim_ok, {r_("coalesce(n_samples / CAST(nullif(n_labels, 0) AS DOUBLE), 0)")} AS sample_label_ratio
FROM a LEFT JOIN b USING (split, date)"""
)
def shape_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as samples, a label for every tenth; the class stands for the day."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("train").alias("split"), F.col("label").cast("string").alias("date"), "vec_id", F.col("embedding").alias("features"))
    return q.shape(v, v.where("vec_id % 10 = 0"), 64)


_PER = {k: r_(pct_(f"count(*) FILTER (WHERE label = {v})", "count(*)")) for k, v in (("up", 1), ("down", -1), ("stable", 0))}


@query(ticks_sql(f"SELECT date, count(*) AS n_samples, count(label) AS n_labels, {_PER['up']} AS label_up_pct, {_PER['down']} AS label_down_pct, {_PER['stable']} AS label_stable_pct FROM ticks GROUP BY date"))
def day_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.day_statistics(tick_frame(spark, sf_dir, gidx=False))


@query(
    ticks_sql(
        f"""SELECT m.date, m.i AS seq, m.label, {r_("t.v")} AS v FROM m JOIN n USING (date) JOIN ticks t ON t.date = m.date AND t.seq = least(m.i * 2 + 4, n.n - 1)""",
        "m AS (SELECT date, seq // 2 AS i, label FROM ticks WHERE seq % 2 = 0)",
        "n AS (SELECT date, count(*) AS n FROM ticks GROUP BY date)",
    )
)
def aligned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label every second row, windows of five rows; labels past the end take the day's last row."""
    df = tick_frame(spark, sf_dir, gidx=False).withColumn("split", F.lit("train"))
    labels = df.where("seq % 2 = 0").select("split", "date", F.floor(F.col("seq") / 2).cast("long").alias("seq"), "label")
    return aligned(df.select("split", "date", "seq", "v"), labels, window=5, stride=2).select("date", "seq", "label", "v")


@query(ticks_sql(f"SELECT gidx, label, {r_('v')} AS v FROM ticks WHERE gidx % 7 = 0 AND gidx < 7000"))
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row of the global order, a thousand of them: the sampling operator."""
    return tick_frame(spark, sf_dir).where("gidx % 7 = 0 and gidx < 7000").select("gidx", "label", "v")
