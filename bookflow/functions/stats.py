"""Column expressions and small numeric helpers for moments and test statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Below this standard deviation a series counts as constant.
TINY = 1e-10


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite(c: Column) -> Column:
    """c where it is finite, else null, which every aggregate skips."""
    return F.when(is_finite(c), c)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r over rows where both are set; null if either is constant. Mergeable, and never divides by zero."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when((F.stddev_pop(x) >= TINY) & (F.stddev_pop(y) >= TINY), r)


def pairs(x: Column, y: Column) -> Column:
    """Aggregate: rows where both are set."""
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def digamma(n: Column) -> Column:
    """The digamma function at positive integers."""
    x = n.cast("double")
    small = F.lit(None).cast("double")
    total = -0.5772156649015329
    cases = F.when(n <= 1, F.lit(total))
    for k in range(2, 8):
        total += 1 / (k - 1)
        cases = cases.when(n == k, F.lit(total))
    x2 = x * x
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x2) + 1 / (120 * x2 * x2) - 1 / (252 * x2 * x2 * x2)
    return F.coalesce(cases.otherwise(small), series)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation r of n pairs, by Student's t with n - 2 degrees of freedom."""
    if r is None or not np.isfinite(r) or n < 3:
        return float("nan")
    return beta_inc((n - 2) / 2, 0.5, max(0.0, 1 - r * r))


@F.pandas_udf(DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    """correlation_p on a small result table."""
    return pd.Series([correlation_p(a, b) for a, b in zip(r, n)])


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))
