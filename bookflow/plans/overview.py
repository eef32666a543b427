"""Queries on a dataset as a whole: overview per split, categorical columns, signal metadata, label analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overview as ov
from ..schema import CATEGORIES, EXPECTED_SIGN, INDEX, KIND, SIGNALS
from ..streaming.labels import label_analysis as analysis
from .base import Registry, pct_, r_, tick_frame, tick_long, ticks_sql
from .dynamics import _LABEL_SOURCE, _acf

query = Registry()


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks in three splits by day of month; v is not a number where k mod 50 is 7, infinite where it is 8."""
    day = F.substring("date", 9, 2).cast("int")
    split = F.when(day <= 18, "train").when(day <= 24, "val").otherwise("test")
    x = F.when(F.col("k") % 50 == 7, float("nan")).when(F.col("k") % 50 == 8, float("inf")).otherwise(F.col("v"))
    return tick_frame(spark, sf_dir, gidx=False).select(split.alias("split"), "date", "label", x.alias("x"), "k", "dv")


_FAULTY = """f AS (SELECT CASE WHEN CAST(substr(date, 9, 2) AS INTEGER) <= 18 THEN 'train' WHEN CAST(substr(date, 9, 2) AS INTEGER) <= 24 THEN 'val' ELSE 'test' END AS split, date, label,
  CASE WHEN k % 50 = 7 THEN CAST('nan' AS DOUBLE) WHEN k % 50 = 8 THEN CAST('inf' AS DOUBLE) ELSE v END AS x, k, dv FROM ticks)"""
_FAULTY_LONG = "fl AS (SELECT split, 'x' AS signal, x AS value FROM f UNION ALL SELECT split, 'k', k FROM f UNION ALL SELECT split, 'dv', dv FROM f)"
_FINITE = "FILTER (WHERE isfinite(value))"


@query(
    ticks_sql(
        f"""SELECT c.split, c.signal, CASE WHEN c.signal IS NULL THEN n_days END AS n_days, CASE WHEN c.signal IS NULL THEN first_date END AS first_date, CASE WHEN c.signal IS NULL THEN last_date END AS last_date,
  CASE WHEN c.signal IS NULL THEN n_samples END AS n_samples, CASE WHEN c.signal IS NULL THEN n_labels END AS n_labels, CASE WHEN c.signal IS NULL THEN down_count END AS down_count,
  CASE WHEN c.signal IS NULL THEN stable_count END AS stable_count, CASE WHEN c.signal IS NULL THEN up_count END AS up_count,
  total_values, finite_count, nan_count, total_values - finite_count - nan_count AS inf_count, finite_count = total_values AS is_clean,
  CASE WHEN c.signal IS NOT NULL THEN {r_("mean")} END AS mean, CASE WHEN c.signal IS NOT NULL THEN {r_("std")} END AS std, CASE WHEN c.signal IS NOT NULL THEN {r_("low")} END AS min, CASE WHEN c.signal IS NOT NULL THEN {r_("high")} END AS max
FROM c JOIN d ON d.split IS NOT DISTINCT FROM c.split""",
        _FAULTY,
        _FAULTY_LONG,
        f"c AS (SELECT split, signal, count(value) AS total_values, count(*) {_FINITE} AS finite_count, count(*) FILTER (WHERE isnan(value)) AS nan_count, avg(value) {_FINITE} AS mean, stddev_pop(value) {_FINITE} AS std, min(value) {_FINITE} AS low, max(value) {_FINITE} AS high FROM fl GROUP BY GROUPING SETS ((split, signal), (signal), (split), ()))",
        "d AS (SELECT split, count(DISTINCT date) AS n_days, min(date) AS first_date, max(date) AS last_date, count(*) AS n_samples, count(label) AS n_labels, count(*) FILTER (WHERE label = -1) AS down_count, count(*) FILTER (WHERE label = 0) AS stable_count, count(*) FILTER (WHERE label = 1) AS up_count FROM f GROUP BY GROUPING SETS ((split), ()))",
    )
)
def split_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.overview(_faulty(spark, sf_dir), ["x", "k", "dv"])


#: Columns under the names that are checked, some of them with values that are not expected.
_CATEGORICAL = {"book_valid": "label * label", "time_regime": "regime", "mbo_ready": "label", "invalidity_delta": "k", "schema_version_feature": "CAST(2.1 AS DOUBLE)"}


def _checked(name: str, of: str) -> str:
    want = CATEGORIES[name]
    listed = "[" + ", ".join(f"CAST({x} AS FLOAT)" for x in want or []) + "]"
    bad = f"count(DISTINCT CAST({of} AS FLOAT)) FILTER (WHERE NOT list_contains({listed}, CAST({of} AS FLOAT)))" if want is not None else "CAST(0 AS BIGINT)"
    met = f"count(DISTINCT CAST({of} AS FLOAT)) FILTER (WHERE list_contains({listed}, CAST({of} AS FLOAT)))" if want is not None else "CAST(0 AS BIGINT)"
    return f"SELECT '{name}' AS name, count({of}) AS n_values, count(DISTINCT CAST({of} AS FLOAT)) AS n_unique, {bad} AS n_unexpected, {len(want or [])} - {met} AS n_missing, {bad} = 0 AS is_valid FROM ticks"


@query(ticks_sql(" UNION ALL ".join(_checked(n, of) for n, of in _CATEGORICAL.items())))
def categorical_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tick_frame(spark, sf_dir, gidx=False)
    return ov.categories(df.select(*[F.expr(of).alias(n) for n, of in _CATEGORICAL.items()]), CATEGORIES)


#: Features that the tick signals stand for here: two signals of different kinds, and an index that has none.
_INDEX = {"v": 84, "k": 92, "dv": 200}
_INFO = "info AS (SELECT * FROM (VALUES " + ", ".join(f"({INDEX[s]}, '{s}', '{KIND[s]}', '{EXPECTED_SIGN[s]}')" for s in SIGNALS) + ") t(i, name, kind, expected_sign))"


@query(
    ticks_sql(
        f"""SELECT idx AS index, coalesce(name, 'signal_' || idx) AS signal, coalesce(kind, 'unknown') AS kind, coalesce(expected_sign, '?') AS expected_sign, n, {r_("mean")} AS mean, CASE WHEN kind = 'continuous' THEN {r_("far")} ELSE 0 END AS pct_outliers
FROM (SELECT signal AS tick, count(*) AS n, avg(value) AS mean, 100 * CAST(count(*) FILTER (WHERE abs(value - m) > 1.5 * s AND s > 0) AS DOUBLE) / count(*) AS far
  FROM (SELECT signal, value, avg(value) OVER (PARTITION BY signal) AS m, stddev_pop(value) OVER (PARTITION BY signal) AS s FROM long) GROUP BY signal)
JOIN (VALUES {", ".join(f"('{s}', {k})" for s, k in _INDEX.items())}) x(tick, idx) USING (tick) LEFT JOIN info ON info.i = idx""",
        _INFO,
    )
)
def signal_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.element_at(F.create_map(*[F.lit(x) for kv in _INDEX.items() for x in kv]), F.col("signal"))
    long = ov.described(tick_long(spark, sf_dir, gidx=False).withColumn("index", index).drop("signal"))
    each = long.groupBy("index", "signal", "kind", "expected_sign").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    kinds = F.element_at(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv]), F.col("signal"))
    return each.join(ov.outliers(long, kinds, 1.5), "signal").select("index", "signal", "kind", "expected_sign", "n", "mean", "pct_outliers")


_NAMES = "names AS (SELECT * FROM (VALUES (-1, 'Down'), (0, 'Stable'), (1, 'Up')) t(label, name))"


@query(
    ticks_sql(
        f"""SELECT 'range' AS section, min(date) AS item, max(date) AS other, count(DISTINCT date) AS n, CAST(NULL AS DOUBLE) AS value FROM ticks
UNION ALL SELECT 'distribution', 'total', NULL, count(*), 100 FROM ticks
UNION ALL SELECT 'distribution', name, NULL, count(*) FILTER (WHERE t.label = names.label), {r_(pct_("count(*) FILTER (WHERE t.label = names.label)", "count(*)"))} FROM ticks t CROSS JOIN names GROUP BY name
UNION ALL SELECT 'day', date, name, count(*) FILTER (WHERE t.label = names.label), {r_(pct_("count(*) FILTER (WHERE t.label = names.label)", "count(*)"))} FROM ticks t CROSS JOIN names GROUP BY date, name
UNION ALL SELECT 'transition', CAST(a.label AS VARCHAR), CAST(b.label AS VARCHAR), count(was) FILTER (WHERE st.label = b.label AND was = a.label), {r_("coalesce(count(was) FILTER (WHERE st.label = b.label AND was = a.label) / CAST(nullif(count(was) FILTER (WHERE was = a.label), 0) AS DOUBLE), 0)")} FROM st0 st CROSS JOIN names a CROSS JOIN names b GROUP BY a.label, b.label
UNION ALL SELECT 'autocorrelation', CAST(lag AS VARCHAR), NULL, NULL, {r_("acf")} FROM acf WHERE lag < 20""",
        _NAMES,
        "st0 AS (SELECT label, lag(label) OVER (PARTITION BY date ORDER BY seq) AS was FROM ticks)",
        *_acf(_LABEL_SOURCE),
    )
)
def label_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(tick_frame(spark, sf_dir))
