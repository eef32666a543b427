"""Distribution and stationarity of signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TINY, normal_cdf
from .frames import BLOCK, exact_quantiles, halo
from .quality import percent


def distribution_stats(long: DataFrame, outlier: float = 3.0, step: int = 1, most: int | None = None) -> DataFrame:
    """Per signal: mean, std, min, max, median, population skewness and excess kurtosis (null when constant), percentage beyond `outlier` deviations, p of normality. NaN spreads, as nothing is filtered."""
    v = F.col("value")
    whole = long.groupBy("signal").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    middle = exact_quantiles(long, [0.5]).select("signal", F.col("q").alias("median"))
    far = long.join(F.broadcast(whole.select("signal", "mean", "std")), "signal").groupBy("signal").agg(F.count_if(F.abs(v - F.col("mean")) > outlier * F.col("std")).alias("_far"))
    out = whole.join(middle, "signal", "left").join(far, "signal").withColumn("pct_outliers", F.when(F.col("std") > TINY, percent(F.col("_far"), F.col("n"))).otherwise(0.0)).drop("_far")
    return out.join(normality(long, step, most), "signal", "left")


def normality(long: DataFrame, step: int = 1, most: int | None = None) -> DataFrame:
    """(signal, k2, p_normal): the omnibus test of D'Agostino and Pearson over all rows; null below 20 rows or for a constant.

    Any long series is significantly non-normal. With step and most only every step-th row of the global order
    is tested, `most` of them: then long needs gidx.
    """
    rows = long if step == 1 else long.where(F.col("gidx") % step == 0)
    rows = rows if most is None else rows.where(F.col("gidx") < step * most)
    v = F.col("value")
    got = rows.groupBy("signal").agg(F.count(v).cast("double").alias("n"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k"), F.stddev_pop(v).alias("sd"))
    n, s, k = F.col("n"), F.col("s"), F.col("k") + 3
    # skewness to a normal score (D'Agostino 1970)
    y = s * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    alpha = F.sqrt(2.0 / (w2 - 1))
    z1 = F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1)) / F.sqrt(0.5 * F.log(w2))
    # kurtosis to a normal score (Anscombe and Glynn 1983)
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (k - e) / F.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / b1 * (2.0 / b1 + F.sqrt(1 + 4.0 / (b1 * b1)))
    t1 = 1 - 2 / (9.0 * a)
    d = 1 + x * F.sqrt(2 / (a - 4.0))
    z2 = (t1 - F.signum(d) * F.pow((1 - 2.0 / a) / F.abs(d), F.lit(1 / 3))) / F.sqrt(2 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    usable = got.where((n >= 20) & (F.col("sd") > TINY))
    return usable.select("signal", k2.alias("k2"), F.exp(-k2 / 2).alias("p_normal"))


def rolling_stats(long: DataFrame, window: int = 10_000, n_windows: int = 10) -> DataFrame:
    """Per signal: drift and range of window means and deviations. Windows start every max(1, (n - window) // n_windows) rows and may overlap; below two windows of rows all is zero and stable.

    Each row is dealt to the windows that hold it; windows are plain aggregates, so nothing is sorted.
    """
    whole = long.groupBy("signal").agg(F.count("*").alias("_n"), F.stddev_pop("value").alias("_sd"))
    room = F.col("_n") - window
    step = F.greatest(F.lit(1), F.floor(room / F.lit(n_windows)))
    many = F.ceil(room / step)
    sized = long.join(F.broadcast(whole), "signal").where(F.col("_n") >= 2 * window)
    lo = F.greatest(F.lit(0), F.floor((F.col("gidx") - window) / step) + 1)
    hi = F.least(many - 1, F.floor(F.col("gidx") / step))
    dealt = sized.where(lo <= hi).select("signal", "value", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("w"))
    each = dealt.groupBy("signal", "w").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    got = each.groupBy("signal").agg(
        F.count("*").alias("n_windows"), (F.max_by("m", "w") - F.min_by("m", "w")).alias("mean_drift"), (F.max_by("s", "w") - F.min_by("s", "w")).alias("std_drift"), F.min("m").alias("min_mean"), F.max("m").alias("max_mean")
    )
    full = whole.join(got, "signal", "left").fillna(0.0, ["mean_drift", "std_drift", "min_mean", "max_mean"]).fillna(0, ["n_windows"])
    span, short = F.col("max_mean") - F.col("min_mean"), F.col("_n") < 2 * window
    return full.select(
        "signal", "n_windows", "mean_drift", "std_drift", "min_mean", "max_mean", span.alias("mean_range"), (short | (span < 0.5 * F.col("_sd"))).alias("is_mean_stable"), (short | (F.abs("std_drift") < 0.3 * F.col("_sd"))).alias("is_std_stable")
    )


#: MacKinnon's response surfaces for the constant-only Dickey-Fuller test (p 1994, critical values 2010).
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_SMALL_P = (2.1659, 1.4412, 0.038269)
_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def adf_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    return normal_cdf(sum(c * tau**k for k, c in enumerate(_SMALL_P if tau <= _TAU_STAR else _LARGE_P)))


#: Blocks whose triangular factors meet in a task.
_FAN = 64


def _columns(x: np.ndarray, at: np.ndarray, lags: int) -> np.ndarray:
    """Rows t of the regression: 1, x_{t-1}, dx_{t-1}, ..., dx_{t-lags}, and last dx_t."""
    d = np.diff(x)
    return np.stack([np.ones(len(at)), x[at - 1], *[d[at - 1 - k] for k in range(1, lags + 1)], d[at - 1]], axis=1)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of rows, padded with zeros where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.concatenate([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _factors(long: DataFrame, lags: int, blocks: int) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per signal: rows and triangular factor of the regression over rows t > lags, and the first lags + 1 values.

    long: (signal, gidx, value), values less their signal's mean, which changes nothing as the regression has a constant, and keeps all
    digits of a small spread at a large level. Each task factors its blocks; factors are stacked and factored again in a tree,
    so that no task holds more than `_FAN` of them and no product of the values (whose condition is the square) is formed.
    """
    size = lags + 3

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gidx")
        x, t, own = pdf["value"].to_numpy(), pdf["gidx"].to_numpy(), pdf["_own"].to_numpy()
        at = np.flatnonzero(own & (t > lags) & (np.arange(len(x)) >= lags + 1))
        r = _triangle(_columns(x, at, lags)) if len(at) else np.zeros((size, size))
        return pd.DataFrame({"signal": [pdf["signal"].iloc[0]], "part": [pdf["_block"].iloc[0]], "n": [len(at)], "r": [r.ravel()], "head": [x[: lags + 1] if t[0] == 0 else None]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(np.concatenate([np.asarray(x).reshape(size, size) for x in pdf.sort_values("part")["r"]]))
        head = next((x for x in pdf["head"] if x is not None), None)
        return pd.DataFrame({"signal": [pdf["signal"].iloc[0]], "part": [pdf["part"].iloc[0] // _FAN], "n": [pdf["n"].sum()], "r": [r.ravel()], "head": [head]})

    schema = "signal string, part long, n long, r array<double>, head array<double>"
    parts = halo(long.select("signal", "gidx", "value"), lags + 1).groupBy("signal", "_block").applyInPandas(block, schema)
    while True:
        parts = parts.groupBy("signal", F.floor(F.col("part") / _FAN)).applyInPandas(merge, schema)
        blocks = -(-blocks // _FAN)
        if blocks <= 1:
            break
    got = parts.collect()  # signals times size^2
    return {x.signal: (x.n, np.array(x.r).reshape(size, size), np.array(x.head or [], float)) for x in got}


def _fit(r: np.ndarray, n: int, k: int) -> tuple[float, float]:
    """AIC and the t of the level's coefficient with the first k lagged differences, from a triangular factor; (inf, 0) where these columns depend on each other."""
    c = k + 2
    own = np.abs(np.diagonal(r)[:c])
    if (own <= 1e-10 * np.sqrt((r[:, :c] ** 2).sum(0))).any():
        return math.inf, 0.0
    rss = max(float((r[c:, -1] ** 2).sum()), 1e-300)
    aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * c
    inverse = np.linalg.inv(r[:c, :c])
    beta = inverse @ r[:c, -1]
    return aic, float(beta[1] / math.sqrt(max(rss / max(n - c, 1) * float((inverse[1] ** 2).sum()), 1e-300)))


def _with_head(r: np.ndarray, n: int, head: np.ndarray, lags: int, k: int) -> tuple[int, np.ndarray]:
    """Rows and factor for k lags from those for `lags`: fewer lags leave room for the rows k + 1 to lags, which the first values give."""
    at = np.arange(k + 1, lags + 1)
    own = r[:, [*range(k + 2), r.shape[1] - 1]]
    return n + at.size, _triangle(np.concatenate([own, _columns(head, at, k)]) if at.size else own)


def stationarity(long: DataFrame, max_samples: int | None = None, lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller per signal over all rows, constant only, lags by AIC up to ceil(12 (n / 100)^(1/4)), or `lags` where given.

    The lag with the least AIC is read off one triangular factor, over the rows that all lags share; the statistic is then
    that of all rows which the chosen lag leaves. With max_samples every (n // max_samples)-th row is taken instead.
    (signal, n, lags, adf_statistic, p_value, critical values, is_stationary, reading). Too short or constant: statistic 0, p 1.
    """
    spark = long.sparkSession
    # a row a signal
    seen = long.groupBy("signal").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("s"), F.avg("value").alias("m")).collect()
    total = max((r.n for r in seen), default=0)
    step = max(1, total // max_samples) if max_samples else 1
    rows = long if step == 1 else long.where(F.col("gidx") % step == 0).withColumn("gidx", F.floor(F.col("gidx") / step).cast("long"))
    n = -(-total // step)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)) if lags is None else lags
    out = []
    if n >= 2 * most + 6:
        level = {r.signal: r.m for r in seen if r.s is not None and r.s > TINY}
        centre = F.col("value")
        for s, m in level.items():
            centre = F.when(F.col("signal") == s, F.col("value") - m).otherwise(centre)
        own = rows.where(F.col("signal").isin(list(level))).withColumn("value", centre)
        for s, (m, r, head) in (_factors(own, most, n // BLOCK + 2) if level else {}).items():
            k = min(range(most + 1), key=lambda k: (_fit(r, m, k)[0], k)) if lags is None else lags  # noqa: B023
            m, r = _with_head(r, m, head, most, k)
            tau = _fit(r, m, k)[1]
            out.append((s, m, k, tau, adf_p(tau), [float(sum(c / m**j for j, c in enumerate(cs))) for cs in _CRITICAL.values()]))
    out += [(s, int(n), 0, 0.0, 1.0, [None] * 3) for s in {r.signal for r in seen} - {x[0] for x in out}]
    rows_ = [(s, m, k, t, p, *c, p < 0.05, "stationary" if p < 0.05 else "marginal" if p < 0.1 else "non-stationary") for s, m, k, t, p, c in sorted(out)]
    return spark.createDataFrame(rows_, "signal string, n long, lags int, adf_statistic double, p_value double, critical_1 double, critical_5 double, critical_10 double, is_stationary boolean, reading string")


def running_day_moments(long: DataFrame) -> DataFrame:
    """(signal, date, n, mean, std) over each day and all before it, from per-day moments: the mergeable form of a running statistic."""
    day = long.groupBy("signal", "date").agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    # measured from the signal's first day, so that no digits go where the mean is much larger than the spread
    day = day.withColumn("_o", F.coalesce(F.first("_m", ignorenulls=True).over(Window.partitionBy("signal").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    w = Window.partitionBy("signal").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    n, off = F.sum("_n").over(w), F.col("_m") - F.col("_o")
    mean = F.sum(F.col("_n") * off).over(w) / n
    square = F.sum(F.col("_n") * (F.col("_v") + off * off)).over(w) / n
    return day.select("signal", "date", n.alias("n"), (F.col("_o") + mean).alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))
