"""What the registered queries share: the registry, rounding, the canonical frame and its SQL twin.

A query and its DuckDB text stand side by side and are named alike. Doubles are rounded on both sides, as two
engines add up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.frames import long_form
from ..sources.tables import TICK_SIGNALS, ticks

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, digits: int = DIGITS):
        """Registers a query under its function's name, its doubles rounded, with its SQL if there is any."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every double rounded; negative zero becomes zero."""
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])


def tick_frame(spark: SparkSession, sf_dir: str, gidx: bool = True) -> DataFrame:
    return ticks(spark, sf_dir, gidx=gidx)


def tick_long(spark: SparkSession, sf_dir: str, gidx: bool = True) -> DataFrame:
    return long_form(ticks(spark, sf_dir, gidx=gidx), TICK_SIGNALS)


#: The canonical frame over `events`, and a row per signal.
TICKS = """
e AS (
  SELECT CAST(ts AS DATE) AS d, ts, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
), s AS (
  SELECT d, ts, v, k, row_number() OVER w - 1 AS seq, v - coalesce(lag(v) OVER w, v) AS dv, lead(v) OVER w - v AS step
  FROM e WINDOW w AS (PARTITION BY d ORDER BY ts)
), ticks AS (
  SELECT CAST(d AS VARCHAR) AS date, seq, row_number() OVER (ORDER BY d, ts) - 1 AS gidx, v, k, dv,
    CASE WHEN step > 5 THEN 1 WHEN step < -5 THEN -1 ELSE 0 END AS label,
    CASE WHEN hour(ts) < 6 THEN 0 WHEN hour(ts) < 10 THEN 1 WHEN hour(ts) < 16 THEN 2 WHEN hour(ts) < 20 THEN 3 ELSE 4 END AS regime
  FROM s WHERE step IS NOT NULL
), long AS (
  SELECT date, seq, gidx, label, regime, 'v' AS signal, v AS value FROM ticks
  UNION ALL SELECT date, seq, gidx, label, regime, 'k', k FROM ticks
  UNION ALL SELECT date, seq, gidx, label, regime, 'dv', dv FROM ticks
)"""


def ticks_sql(body: str, *more: str) -> str:
    """body over the frame above and further common tables."""
    return "WITH " + ", ".join([TICKS.strip(), *(m.strip() for m in more)]) + "\n" + body.strip()


def r_(expression: str, digits: int = DIGITS) -> str:
    """A rounded double in SQL."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def corr_(x: str, y: str) -> str:
    """Pearson's r in SQL over rows where both are set, null if either is constant."""
    x, y = f"CASE WHEN ({y}) IS NOT NULL THEN ({x}) END", f"CASE WHEN ({x}) IS NOT NULL THEN CAST(({y}) AS DOUBLE) END"
    return f"CASE WHEN stddev_pop({x}) >= 1e-10 AND stddev_pop({y}) >= 1e-10 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


def tail_(r: str, n: str, steps: int = 2000) -> str:
    """Two-sided p of a correlation r of n pairs in SQL: Student's t integrated by Simpson's rule over the angle whose sine is |r|."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    angle = f"asin(least(abs({r}), CAST(1 AS DOUBLE)))"
    area = f"(SELECT sum({weight} * pow(cos(i * {angle} / {steps}), {n} - 3)) FROM range({steps + 1}) t(i)) * {angle} / {3 * steps}"
    return f"1 - 2 * exp(lgamma(({n} - 1) / CAST(2 AS DOUBLE)) - lgamma(({n} - 2) / CAST(2 AS DOUBLE))) / sqrt(pi()) * {area}"


def pct_(part: str, whole: str) -> str:
    return f"coalesce(100 * CAST({part} AS DOUBLE) / nullif({whole}, 0), CAST(0 AS DOUBLE))"
