"""Shapes, data quality, label distribution, categorical checks and column statistics. One aggregate each, mergeable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, is_finite
from ..schema import LABELS
from .frames import exact_quantiles


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole.cast("double")), F.lit(0.0))


def column_stats(long: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Count, mean, population deviation, least and greatest of the finite values of each signal; a signal without any keeps a row of nulls and zeros."""
    v = finite(F.col("value"))
    return long.groupBy(*by).agg(
        F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def merge_stats(parts: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Statistics of a whole from rows (n, mean, std, min, max) of its parts: the parallel combination of moments."""
    # means are taken from the first part's, so that no digits go where they are much larger than the spread
    whole = Window.partitionBy(*by)
    full = parts.where("n > 0").withColumn("_o", F.first("mean").over(whole)).withColumn("_d", F.col("mean") - F.col("_o"))
    n = F.sum("n")
    off = F.sum(F.col("n") * F.col("_d")) / n
    square = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("_d") * F.col("_d"))) / n
    return full.groupBy(*by).agg(n.alias("n"), (F.first("_o") + off).alias("mean"), F.sqrt(F.greatest(square - off * off, F.lit(0.0))).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"))


def data_quality(long: DataFrame) -> DataFrame:
    """One row: values, finite, NaN and infinite counts and percentages, which signals hold either, and whether all is clean."""
    nan, inf = F.isnan("value"), F.abs(F.col("value")) == float("inf")
    each = long.groupBy("signal").agg(F.count("value").alias("n"), F.count_if(nan).alias("nan"), F.count_if(~nan & inf).alias("inf"))
    where = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.col("signal"))))  # noqa: E731  # as long as there are signals
    one = each.agg(F.sum("n").alias("total_values"), F.sum("nan").alias("nan_count"), F.sum("inf").alias("inf_count"), where("nan").alias("columns_with_nan"), where("inf").alias("columns_with_inf"))
    finite_ = F.col("total_values") - F.col("nan_count") - F.col("inf_count")
    return one.select(
        "total_values",
        finite_.alias("finite_count"),
        "nan_count",
        "inf_count",
        percent(finite_, F.col("total_values")).alias("pct_finite"),
        percent(F.col("nan_count"), F.col("total_values")).alias("pct_nan"),
        percent(F.col("inf_count"), F.col("total_values")).alias("pct_inf"),
        "columns_with_nan",
        "columns_with_inf",
        (finite_ == F.col("total_values")).alias("is_clean"),
    )


def label_distribution(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and percentages of labels, imbalance (greatest over least count, a missing class counting as one row), balance below 1.5, majority and minority; ties go Down, Stable, Up."""
    n = {k: F.count_if(F.col("label") == k) for k in LABELS}
    one = df.groupBy(*by).agg(F.count("label").alias("total"), n[-1].alias("down_count"), n[0].alias("stable_count"), n[1].alias("up_count"))
    cols = [F.col(c) for c in ("down_count", "stable_count", "up_count")]
    most, least = F.greatest(*cols), F.least(*cols)
    first = lambda c: F.when(cols[0] == c, LABELS[-1]).when(cols[1] == c, LABELS[0]).otherwise(LABELS[1])
    ratio = most / F.greatest(least, F.lit(1)).cast("double")
    return one.select(
        *by,
        "total",
        "down_count",
        "stable_count",
        "up_count",
        *[percent(c, F.col("total")).alias(f"{k}_pct") for k, c in zip(("down", "stable", "up"), cols)],
        ratio.alias("imbalance_ratio"),
        (ratio < 1.5).alias("is_balanced"),
        first(most).alias("majority_class"),
        first(least).alias("minority_class"),
    )


def categorical(df: DataFrame, column: str, expected: list[float] | None) -> DataFrame:
    """One row: distinct values with their counts and whether all of them are expected. Values are compared as FLOAT, as they are stored."""
    held = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("float").alias("value")).agg(F.count("*").alias("n"))
    one = held.agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("seen"))
    values = F.transform("seen", lambda s: s["value"])
    wanted = F.lit(None).cast("array<float>") if expected is None else F.array(*[F.lit(x).cast("float") for x in expected]).cast("array<float>")
    extra, missing = F.array_except(values, wanted), F.array_except(wanted, values)
    said = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ", ")
    message = (
        F.when(wanted.isNull(), "none specified")
        .when(F.size(extra) > 0, F.concat(F.lit("unexpected values: "), said(extra)))
        .when(F.size(missing) > 0, F.concat(F.lit("valid, not seen: "), said(missing)))
        .otherwise("all values as expected")
    )
    return one.select(F.lit(column).alias("name"), values.alias("unique_values"), F.transform("seen", lambda s: s["n"]).alias("value_counts"), (wanted.isNull() | (F.size(extra) == 0)).alias("is_valid"), message.alias("message"))


def shape(samples: DataFrame, labels: DataFrame, expected: int = 98) -> DataFrame:
    """Per split and date: samples, labels, feature width and whether it is as expected, samples per label."""
    key = ["split", "date"]
    s = samples.groupBy(*key).agg(F.count("*").alias("n_samples"), F.max(F.size("features")).alias("n_features"), F.min(F.size("features")).alias("_w"))
    m = labels.groupBy(*key).agg(F.count("*").alias("n_labels"))
    full = s.join(m, key, "left").fillna(0, ["n_labels"])
    ok = (F.col("n_features") == expected) & (F.col("_w") == expected)
    ratio = F.coalesce(F.try_divide(F.col("n_samples").cast("double"), F.col("n_labels")), F.lit(0.0))
    return full.select(*key, "n_samples", "n_labels", "n_features", ok.alias("feature_dim_ok"), ratio.alias("sample_label_ratio"))


def signal_statistics(long: DataFrame, outlier: float = 4.0) -> DataFrame:
    """Per signal: moments, exact quartiles, distinct values, percentage beyond `outlier` deviations. Only distinct values are shuffled, to be counted."""
    whole, v = column_stats(long), F.col("value")
    q = exact_quantiles(long, [0.25, 0.5, 0.75]).groupBy("signal").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(c) for p, c in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    rows = long.where(is_finite(v))
    unique = rows.groupBy("signal").agg(F.count_distinct("value").alias("n_unique"))
    far = rows.join(F.broadcast(whole.select("signal", "mean", "std")), "signal").groupBy("signal").agg(F.count_if((F.col("std") > 0) & (F.abs(v - F.col("mean")) > outlier * F.col("std"))).alias("_far"))
    out = whole.join(q, "signal", "left").join(unique, "signal", "left").join(far, "signal", "left")
    return out.withColumn("pct_outliers", percent(F.coalesce("_far", F.lit(0)), F.col("n"))).drop("_far")


def overview(df: DataFrame, split: str = "split") -> DataFrame:
    """Per split and in total (null split): days, samples, labels, first and last date."""
    return df.rollup(split).agg(F.countDistinct("date").alias("n_days"), F.count("*").alias("n_samples"), F.count("label").alias("n_labels"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def memory_estimate(df: DataFrame, split: str = "split", features: int = 98, item_bytes: int = 4) -> DataFrame:
    """Bytes of the samples as dense arrays, per split and in total."""
    n = df.rollup(split).agg(F.count("*").alias("n_samples"))
    size = F.col("n_samples") * (features * item_bytes)
    return n.select(split, "n_samples", size.alias("bytes"), (size / (1 << 20)).alias("mb"), (size / (1 << 30)).alias("gb"))


def complete_cases(df: DataFrame, signals: list[str]) -> DataFrame:
    """Rows in which every signal is finite."""
    for s in signals:
        df = df.where(is_finite(F.col(s)))
    return df
