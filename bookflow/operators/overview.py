"""What a dataset holds, per split and as a whole, from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..schema import signal_info

_LABEL_COUNTS = {-1: "down_count", 0: "stable_count", 1: "up_count"}


def overview(df: DataFrame, signals: list[str], split: str = "split", date: str = "date") -> DataFrame:
    """Rows (split, signal) of a frame of samples: null split stands for all splits, null signal for the rows as such.

    Signal rows have n, NaN and infinite counts, moments and extremes of the finite values; the others days, dates, samples, labels by
    kind, and the counts of all their values. The scan is reduced to a row per split, day and signal, by partial aggregates; the
    grouping sets (split, signal), (signal), (split) and () are of those rows and not of the samples.
    """
    v = {s: F.col(s).cast("double") for s in signals}
    ok = {s: finite(v[s]) for s in signals}
    cells = lambda f: F.array(*[f(s) for s in signals])
    parts = df.groupBy(split, date).agg(
        F.count("*").alias("samples"),
        F.count("label").alias("labels"),
        *[F.count_if(F.col("label") == k).alias(c) for k, c in _LABEL_COUNTS.items()],
        cells(lambda s: F.struct(F.lit(s).alias("signal"), F.count(v[s]).alias("values"), F.count(ok[s]).alias("n"), F.count_if(F.isnan(v[s])).alias("nan"), F.avg(ok[s]).alias("m"), F.var_pop(ok[s]).alias("var"), F.min(ok[s]).alias("lo"), F.max(ok[s]).alias("hi"))).alias("cells"),
    )
    # the day's own counts stand on its first signal's row only, so that sums over signals count them once
    rows = parts.select(split, date, "samples", "labels", *_LABEL_COUNTS.values(), F.posexplode("cells").alias("k", "c")).select("*", "c.*").drop("cells", "c")
    own = lambda c: F.sum(F.when(F.col("k") == 0, F.col(c)))
    # moments are taken from a value near them: that of the signal's least day
    rows = rows.withColumn("o", F.min("m").over(Window.partitionBy("signal"))).withColumn("d", F.col("m") - F.col("o"))  # a row a day
    n = F.sum("n")
    off = F.try_divide(F.sum(F.col("n") * F.col("d")), n)
    square = F.try_divide(F.sum(F.col("n") * (F.col("var") + F.col("d") * F.col("d"))), n)
    whole = rows.groupingSets([[F.col(split), F.col("signal")], [F.col("signal")], [F.col(split)], []], split, "signal").agg(
        F.grouping("signal").alias("_all"),
        F.countDistinct(date).alias("n_days"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        own("samples").alias("n_samples"),
        own("labels").alias("n_labels"),
        *[own(c).alias(c) for c in _LABEL_COUNTS.values()],
        F.sum("values").alias("total_values"),
        n.alias("finite_count"),
        F.sum("nan").alias("nan_count"),
        (F.min("o") + off).alias("mean"),
        F.sqrt(F.greatest(square - off * off, F.lit(0.0))).alias("std"),
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
    )
    only = lambda wanted, c: F.when(F.col("_all") == wanted, F.col(c)).alias(c)
    return whole.select(
        split,
        "signal",
        *[only(1, c) for c in ("n_days", "first_date", "last_date", "n_samples", "n_labels", *_LABEL_COUNTS.values())],
        "total_values",
        "finite_count",
        "nan_count",
        (F.col("total_values") - F.col("finite_count") - F.col("nan_count")).alias("inf_count"),
        (F.col("finite_count") == F.col("total_values")).alias("is_clean"),
        *[only(0, c) for c in ("mean", "std", "min", "max")],
    )


def categories(df: DataFrame, expected: dict[str, list[float] | None]) -> DataFrame:
    """(name, n_values, n_unique, n_unexpected, n_missing, is_valid) of each categorical column, in one scan; None expects nothing in particular. Values are compared as FLOAT, as they are stored."""
    names = list(expected)
    held = df.select(*[F.col(c).cast("float").alias(c) for c in names]).unpivot([], names, "name", "value").where("value is not null")
    seen = held.groupBy("name", "value").agg(F.count("*").alias("n"))
    known = F.lit(None).cast("array<float>")
    for c, values in expected.items():
        if values is not None:
            known = F.when(F.col("name") == c, F.array(*[F.lit(x).cast("float") for x in values])).otherwise(known)
    seen = seen.withColumns({"_known": known, "_free": known.isNull()}).withColumn("_ok", F.col("_free") | F.array_contains("_known", F.col("value")))
    got = seen.groupBy("name").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_unique"), F.count_if(~F.col("_ok")).alias("n_unexpected"), F.count_if(F.col("_ok") & ~F.col("_free")).alias("_met"))
    want = F.lit(0)
    for c, values in expected.items():
        want = F.when(F.col("name") == c, len(values or [])).otherwise(want)
    return got.select("name", "n_values", "n_unique", "n_unexpected", (want - F.col("_met")).cast("long").alias("n_missing"), (F.col("n_unexpected") == 0).alias("is_valid"))


def described(rows: DataFrame, index: str = "index") -> DataFrame:
    """rows with signal, kind and expected_sign of a feature's index; an index without a signal is called signal_<index>, of kind unknown and sign ?."""
    info = signal_info(rows.sparkSession)
    known = info.select(F.col("index").alias("_i"), "signal", "kind", "expected_sign")  # as many rows as signals
    out = rows.join(F.broadcast(known), F.col(index) == F.col("_i"), "left").drop("_i")
    return out.withColumns({"signal": F.coalesce("signal", F.concat(F.lit("signal_"), F.col(index).cast("string"))), "kind": F.coalesce("kind", F.lit("unknown")), "expected_sign": F.coalesce("expected_sign", F.lit("?"))})


def outliers(long: DataFrame, kind: Column, far: float = 4.0) -> DataFrame:
    """(signal, pct_outliers): the percentage of values more than `far` deviations from the mean, of continuous signals; 0 for all other kinds."""
    whole = long.groupBy("signal").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    off = F.abs(F.col("value") - F.col("_m")) > far * F.col("_s")
    got = long.join(F.broadcast(whole), "signal").groupBy("signal").agg(F.avg(F.when(off & (F.col("_s") > 0), 100.0).otherwise(0.0)).alias("_p"))
    return got.select("signal", F.when(kind == "continuous", F.col("_p")).otherwise(0.0).alias("pct_outliers"))
