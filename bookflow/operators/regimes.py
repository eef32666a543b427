"""Intraday regimes: label statistics, correlations by regime, seasonality of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TINY, correlation_p_udf, is_finite
from ..schema import REGIMES
from .correlation import finite_correlation
from .quality import percent


def known(df: DataFrame) -> DataFrame:
    """Rows of the known regimes; others, fractions among them, are left out."""
    return df.where(is_finite(F.col("regime").cast("double")) & F.col("regime").isin([*REGIMES]))


def regime_name(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in REGIMES.items():
        out = F.when(c == k, name).otherwise(out)
    return out


def regime_stats(df: DataFrame) -> DataFrame:
    """Per regime: rows, label mean and population deviation, label percentages."""
    n = F.count("label")
    pct = lambda k: percent(F.count_if(F.col("label") == k), n)
    y = F.col("label").cast("double")
    got = known(df).groupBy(F.col("regime").cast("int").alias("regime")).agg(n.alias("n_samples"), F.avg(y).alias("label_mean"), F.stddev_pop(y).alias("label_std"), pct(-1).alias("down_pct"), pct(0).alias("stable_pct"), pct(1).alias("up_pct"))
    return got.withColumn("regime_name", regime_name(F.col("regime")))


def regime_correlations(long: DataFrame, expected: dict[str, str] | None = None, level: float = 0.01) -> DataFrame:
    """(signal, regime, n_samples, correlation, p_value, is_significant, sign_consistent): 0 and p 1 where undefined; an unknown expected sign is consistent."""
    got = finite_correlation(known(long), ("signal", "regime"))
    p = F.coalesce(F.when(F.col("n") >= 3, correlation_p_udf("r", F.col("n").cast("double"))), F.lit(1.0))
    defined = F.col("r").isNotNull() & (F.col("n") >= 3)
    sign = F.lit("?")
    for s, e in (expected or {}).items():
        sign = F.when(F.col("signal") == s, e).otherwise(sign)
    fits = F.when(sign == "+", F.col("r") > 0).when(sign == "-", F.col("r") < 0).otherwise(True)
    return got.select("signal", "regime", F.col("n").alias("n_samples"), F.when(defined, F.col("r")).otherwise(0.0).alias("correlation"), F.when(defined, p).otherwise(1.0).alias("p_value"), (defined & (p < level)).alias("is_significant"), (defined & fits).alias("sign_consistent"))


def seasonality(correlations: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(signal, correlation_range, most_predictive_regime, least_predictive_regime, is_regime_dependent, regime_impact_ratio) from |r| by regime; the first regime of equals."""
    a = F.abs("correlation")
    got = correlations.groupBy("signal").agg(
        F.max(a).alias("_hi"), F.min(a).alias("_lo"), F.min_by("regime", F.struct(-a, "regime")).alias("most_predictive_regime"), F.min_by("regime", F.struct(a, "regime")).alias("least_predictive_regime")
    )
    ratio = F.when(F.col("_lo") > TINY, F.col("_hi") / F.col("_lo")).when(F.col("_hi") > TINY, float("inf")).otherwise(1.0)
    span = F.col("_hi") - F.col("_lo")
    return got.select("signal", span.alias("correlation_range"), "most_predictive_regime", "least_predictive_regime", (span > threshold).alias("is_regime_dependent"), ratio.alias("regime_impact_ratio"))


def regime_importance(correlations: DataFrame) -> DataFrame:
    """(regime, importance): mean |r| over signals."""
    return correlations.groupBy("regime").agg(F.avg(F.abs("correlation")).alias("importance"))


def regime_summary(df: DataFrame, long: DataFrame) -> dict:
    """All of the above as one small result, with advice."""
    from .advice import regime_advice

    stats, cor = regime_stats(df), regime_correlations(long)
    season, importance = seasonality(cor), regime_importance(cor)
    return {
        "regime_stats": [r.asDict() for r in stats.orderBy("regime").collect()],
        "regime_correlations": [r.asDict() for r in cor.orderBy("signal", "regime").collect()],
        "signal_seasonality": [r.asDict() for r in season.orderBy("signal").collect()],
        "overall_regime_importance": {r.regime: r.importance for r in importance.collect()},
        "recommendations": [r.asDict() for r in regime_advice(stats, season, importance).collect()],
    }
