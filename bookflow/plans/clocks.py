"""Queries on samples and labels that run on different clocks, and the unit-root regression at a fixed lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clocks
from ..operators import distribution as dist
from ..operators.frames import long_form
from ..operators.temporal import DECAY_LAGS
from ..sources.tables import two_clocks
from .base import Registry, corr_, r_, tick_long, ticks_sql
from .dynamics import _RANKS, auc_

query = Registry()

_SIGNALS = ["v", "k"]
_CLOCKS = """
s AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS t, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
sl AS (SELECT t, 'v' AS signal, v AS value FROM s UNION ALL SELECT t, 'k', k FROM s),
y AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_totalprice < 150000 THEN -1 ELSE 0 END AS label FROM orders)"""
_WINDOWS = "w AS (SELECT i, signal, count(*) AS n, arg_min(value, t) AS head, arg_max(value, t) AS tail, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS std FROM sl JOIN (SELECT i FROM range((SELECT count(*) FROM s)) x(i)) ON t BETWEEN i * 10 AND i * 10 + 99 GROUP BY i, signal HAVING count(*) = 100)"


def _sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([_CLOCKS.strip(), *more]) + "\n" + body


@query(_sql(f"SELECT signal, CAST(g.k AS INTEGER) AS lag, count(*) AS n, {r_('CASE WHEN count(*) >= 100 THEN coalesce(' + corr_('value', 'label') + ', 0) ELSE 0 END')} AS r FROM y CROSS JOIN (SELECT unnest({DECAY_LAGS}) AS k) g JOIN sl ON t = i * 10 + 99 - g.k GROUP BY signal, g.k"))
def decay_two_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.decay(*two_clocks(spark, sf_dir), _SIGNALS)


@query(_sql(f"SELECT signal, i, n, {r_('head')} AS start, {r_('tail')} AS \"end\", {r_('low')} AS low, {r_('high')} AS high, {r_('mean')} AS mean, {r_('std')} AS std FROM w", _WINDOWS))
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.windows(long_form(two_clocks(spark, sf_dir)[0], _SIGNALS))


@query(
    _sql(
        f"""SELECT signal, {r_("lr")} AS level_r, {r_("cr")} AS change_r, {r_("la")} AS level_auc, {r_("ca")} AS change_auc,
  CASE WHEN n < 100 THEN 'insufficient_data' WHEN abs(lr) + la - 0.5 > CAST(1.2 AS DOUBLE) * (abs(cr) + ca - 0.5) THEN 'level' WHEN abs(cr) + ca - 0.5 > CAST(1.2 AS DOUBLE) * (abs(lr) + la - 0.5) THEN 'change' ELSE 'both' END AS recommendation
FROM (SELECT split_part(signal, '/', 1) AS signal, max(n) AS n, max(r) FILTER (WHERE signal LIKE '%/level') AS lr, max(r) FILTER (WHERE signal LIKE '%/change') AS cr,
  max(auc) FILTER (WHERE signal LIKE '%/level') AS la, max(auc) FILTER (WHERE signal LIKE '%/change') AS ca
  FROM (SELECT signal, count(*) AS n, coalesce({corr_("value", "label")}, 0) AS r, {auc_(1, False)} AS auc FROM rk GROUP BY signal) GROUP BY 1)""",
        _WINDOWS,
        "lc AS (SELECT signal || '/level' AS signal, label, tail AS value FROM w JOIN y USING (i) UNION ALL SELECT signal || '/change', label, tail - head FROM w JOIN y USING (i))",
        _RANKS.format(of="lc"),
    )
)
def level_vs_change_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, labels = two_clocks(spark, sf_dir)
    return clocks.level_vs_change(long_form(samples, _SIGNALS), labels)


#: Sums of squares and products about the means of dx (y), the level before (x) and the difference before (d).
_SUMS = "g AS (SELECT signal, count(*) AS n, count(*) * var_pop(x) AS xx, count(*) * var_pop(d) AS dd, count(*) * covar_pop(x, d) AS xd, count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(d, y) AS dy, count(*) * var_pop(y) AS yy FROM z WHERE d IS NOT NULL GROUP BY signal)"
_SLOPES = "b AS (SELECT *, (dd * xy - xd * dy) / (xx * dd - xd * xd) AS bx, (xx * dy - xd * xy) / (xx * dd - xd * xd) AS bd FROM g)"


@query(
    ticks_sql(
        f"""SELECT signal, n, 1 AS lags, {r_("bx / sqrt((yy - bx * xy - bd * dy) / (n - 3) * dd / (xx * dd - xd * xd))")} AS adf_statistic,
  {r_("-3.43035 - 6.5393 / n - 16.786 / (n * n) - 79.433 / (CAST(n AS DOUBLE) * n * n)")} AS critical_1 FROM b""",
        "z AS (SELECT signal, value - lag(value) OVER q AS y, lag(value) OVER q AS x, lag(value) OVER q - lag(value, 2) OVER q AS d FROM long WINDOW q AS (PARTITION BY signal ORDER BY gidx))",
        _SUMS,
        _SLOPES,
    )
)
def unit_root_lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.stationarity(tick_long(spark, sf_dir), lags=1).select("signal", "n", "lags", "adf_statistic", "critical_1")
