"""Day-to-day stability and walk-forward validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TINY, pearson


def per_day(long: DataFrame) -> DataFrame:
    """(signal, date, n, mean, std, r): moments and correlation with the label by day; r is 0 up to 10 rows or where undefined."""
    v, y = F.col("value"), F.col("label").cast("double")
    r = F.when(F.count("*") > 10, F.coalesce(pearson(v, y), F.lit(0.0))).otherwise(0.0)
    return long.groupBy("signal", "date").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), r.alias("r"))


def day_stability(days: DataFrame) -> DataFrame:
    """Per signal over its days: mean and deviation of daily means and correlations; stability |mean r| / (std r + 1e-10); stable if above 1 and the sign holds.

    The sign holds unless the first floor(n / 2) + 1 days (in order) have a zero, or all days have three signs.
    """
    sign = F.signum("r")
    ordered = days.withColumns({"_s": sign, "_k": F.row_number().over(Window.partitionBy("signal").orderBy("date")), "_n": F.count("*").over(Window.partitionBy("signal"))})  # one row a day
    got = ordered.groupBy("signal").agg(
        F.count("*").alias("n_days"),
        F.avg("mean").alias("mean_of_means"),
        F.stddev_pop("mean").alias("std_of_means"),
        F.avg("r").alias("mean_of_correlations"),
        F.stddev_pop("r").alias("std_of_correlations"),
        F.countDistinct("_s").alias("_signs"),
        F.count_if((F.col("_s") == 0) & (F.col("_k") <= F.floor(F.col("_n") / 2) + 1)).alias("_zero"),
    )
    m = F.abs("mean_of_correlations")
    score = F.when(m > TINY, m / (F.col("std_of_correlations") + TINY)).otherwise(0.0)
    return got.select("signal", "n_days", "mean_of_means", "std_of_means", "mean_of_correlations", "std_of_correlations", score.alias("stability_score"), ((score > 1) & (F.col("_signs") <= 2) & (F.col("_zero") == 0)).alias("is_stable"))


def walk_forward(long: DataFrame, signal: str, min_train_days: int = 3) -> DataFrame:
    """(test_day, train_days, train_n, test_n, accuracy, test_r): each day from the min_train_days-th on is predicted from all days before it: Up above mean + std / 2 of the signal, Down below mean - std / 2, else Stable.

    The days before are an expanding window over per-day moments, so a fold costs one row, not a rescan.
    """
    own = long.where(F.col("signal") == signal)
    day = own.groupBy("date").agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    # means are taken from the first day's, so that no digits go where they are much larger than the spread
    day = day.withColumn("_o", F.coalesce(F.first("_m", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # over one row a day
    n, off = F.sum("_n").over(w), F.col("_m") - F.col("_o")
    apart = F.sum(F.col("_n") * off).over(w) / n
    square = F.sum(F.col("_n") * (F.col("_v") + off * off)).over(w) / n
    folds = day.select("date", F.count("*").over(w).alias("train_days"), n.alias("train_n"), (F.col("_o") + apart).alias("_mu"), F.sqrt(F.greatest(square - apart * apart, F.lit(0.0))).alias("_sd")).where(F.col("train_days") >= min_train_days)
    half = F.col("_sd") * 0.5
    said = F.when(F.col("value") > F.col("_mu") + half, 1).when(F.col("value") < F.col("_mu") - half, -1).otherwise(0)
    return (
        own.join(folds, "date")
        .groupBy(F.col("date").alias("test_day"))
        .agg(F.max("train_days").alias("train_days"), F.max("train_n").alias("train_n"), F.count("*").alias("test_n"), F.avg((said == F.col("label")).cast("double")).alias("accuracy"), F.coalesce(pearson(F.col("value"), F.col("label").cast("double")), F.lit(0.0)).alias("test_r"))
    )


def generalization_summary(long: DataFrame, signal: str) -> dict:
    """Assessment over days: GOOD, MODERATE or POOR, most and least stable signals, fold accuracy, advice. Below three days an error."""
    from .advice import generalization, generalization_advice, generalization_facts

    facts = generalization_facts(long, signal)
    one = generalization(facts).first()
    if one is None:
        raise ValueError("3 days are needed")
    rows = [r.signal for r in day_stability(per_day(long)).orderBy(F.desc("stability_score"), "signal").collect()]
    return one.asDict() | {"most_stable_signals": rows[:3], "least_stable_signals": rows[-3:], "recommendations": [r.asDict() for r in generalization_advice(facts).collect()]}
