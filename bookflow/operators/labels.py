"""Label dynamics: transitions, autocorrelation, label statistics by day and regime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TINY, correlation_p_udf, finite, pairs, pearson
from .frames import block_window, day_window, halo
from .quality import percent


def transitions(df: DataFrame, across_days: bool = False, states: list[int] | None = None) -> DataFrame:
    """(from_label, to_label, n, probability, share, persistence): row-normalized counts over every pair of states. share is the state's share of all labels, persistence P(s -> s) - share."""
    if across_days:
        rows = halo(df.select("gidx", "label"), 1).withColumn("_from", F.lag("label").over(block_window())).where("_own")
    else:
        rows = df.select("date", "seq", "label").withColumn("_from", F.lag("label").over(day_window()))
    got = rows.where("_from is not null").groupBy(F.col("_from").alias("from_label"), F.col("label").alias("to_label")).agg(F.count("*").alias("n"))
    shares = df.groupBy("label").agg(F.count("*").alias("_n"))
    shares = shares.select("label", F.try_divide(F.col("_n").cast("double"), F.sum("_n").over(Window.partitionBy())).alias("share"))
    if states is not None:
        given = df.sparkSession.createDataFrame([(s,) for s in states], "label int")
        shares = given.join(shares, "label", "left").fillna(0.0, ["share"])
    # as many rows as states
    every = shares.select(F.col("label").alias("from_label"), "share").join(shares.select(F.col("label").alias("to_label")), F.lit(True))
    full = every.join(got, ["from_label", "to_label"], "left").fillna(0, ["n"])
    out = F.sum("n").over(Window.partitionBy("from_label"))
    p = F.coalesce(F.try_divide(F.col("n").cast("double"), out), F.lit(0.0))
    return full.select("from_label", "to_label", "n", p.alias("probability"), "share", F.when(F.col("from_label") == F.col("to_label"), p - F.col("share")).alias("persistence"))


def autocorrelation(long: DataFrame, max_lag: int = 100, by: str = "signal") -> DataFrame:
    """(by, lag, acf) across days: mean product of centred values k apart over the population variance. A constant series has 1 at every lag; lags beyond the series are 0.

    All lags share one Window over blocks with a halo; each task holds a block and its halo at most.
    """
    stats = long.groupBy(by).agg(F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"), F.count("value").alias("_n"))
    centred = long.join(F.broadcast(stats), by).select(by, "gidx", (F.col("value") - F.col("_mean")).alias("_x"))
    blocks = halo(centred, max_lag)
    w = block_window(by)
    lagged = blocks.select(by, "_own", "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)]).where("_own")
    sums = lagged.groupBy(by).agg(*[F.avg(F.col("_x") * F.col(f"_l{k}")).alias(f"_a{k}") for k in range(1, max_lag + 1)])
    wide = sums.join(F.broadcast(stats), by)
    acf = lambda k: F.when(F.col("_var") < TINY, 1.0).otherwise(F.coalesce(F.col(f"_a{k}") / F.col("_var"), F.lit(0.0)))
    cells = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[F.struct(F.lit(k).alias("lag"), acf(k).alias("acf")) for k in range(1, max_lag + 1)])
    return wide.select(by, "_n", F.explode(cells).alias("c")).select(by, "c.lag", "c.acf", (1.96 / F.sqrt(F.col("_n"))).alias("confidence"))


def acf_reading(acf: DataFrame, by: str = "signal") -> DataFrame:
    """(by, half_life, decay_rate, reading): first lag below one half (else the last), -ln of lag 1 where that is in (0, 1), and words for lag 1."""
    one = F.max(F.when(F.col("lag") == 1, F.col("acf")))
    return acf.groupBy(by).agg(
        F.coalesce(F.min(F.when(F.col("acf") < 0.5, F.col("lag"))), F.max("lag")).alias("half_life"),
        F.when((one > 0) & (one < 1), -F.log(one)).otherwise(0.0).alias("decay_rate"),
        F.when(one > 0.1, "strong").when(one > F.max("confidence"), "weak").when(one < -F.max("confidence"), "reverting").otherwise("none").alias("reading"),
    )


def day_statistics(df: DataFrame) -> DataFrame:
    """Per day: samples, labels, label percentages."""
    n = F.count("label")
    pct = lambda k: percent(F.count_if(F.col("label") == k), n)
    return df.groupBy("date").agg(F.count("*").alias("n_samples"), n.alias("n_labels"), pct(1).alias("label_up_pct"), pct(-1).alias("label_down_pct"), pct(0).alias("label_stable_pct"))


def regime_label_stats(df: DataFrame, signal: str, min_samples: int = 100) -> DataFrame:
    """Per regime of at least min_samples rows: label percentages and the signal's correlation with the label, 0 where undefined."""
    n = F.count("*")
    pct = lambda k: percent(F.count_if(F.col("label") == k), n)
    r = F.coalesce(pearson(finite(F.col(signal)), F.col("label").cast("double")), F.lit(0.0))
    got = df.where("regime is not null").groupBy("regime").agg(n.alias("n_samples"), pct(1).alias("up_pct"), pct(-1).alias("down_pct"), pct(0).alias("stable_pct"), r.alias("correlation"))
    return got.where(F.col("n_samples") >= min_samples)


def signal_label_correlations(long: DataFrame) -> DataFrame:
    """Per signal: r with the label and its p; significant below 0.05 over the number of signals (Bonferroni). A constant signal has r 0 and p 1."""
    y = F.col("label").cast("double")
    got = long.groupBy("signal").agg(pearson(F.col("value"), y).alias("r"), pairs(F.col("value"), y).alias("n"))
    p = F.coalesce(correlation_p_udf("r", F.col("n").cast("double")), F.lit(1.0))
    many = F.count("*").over(Window.partitionBy())  # over one row a signal
    return got.select("signal", "n", F.coalesce("r", F.lit(0.0)).alias("correlation"), p.alias("p_value"), (p < 0.05 / many).alias("is_significant"))
