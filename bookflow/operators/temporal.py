"""Temporal dynamics: lead and lag between signals, predictive decay, level against change."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TINY, pairs, pearson
from .frames import block_window, halo
from .labels import acf_reading, autocorrelation

DECAY_LAGS = [0, 1, 2, 5, 10, 20, 50, 100]


def cross_correlation(df: DataFrame, signals: list[str], max_lag: int = 50) -> DataFrame:
    """(signal_a, signal_b, lag, r) for pairs in order and lags -max_lag..max_lag: Pearson of a(t) and b(t + lag) over the rows that have both; positive lags: a leads. 0 where undefined.

    Blocks with a halo are reduced to sums of products in numpy: one matrix product a lag, and per block only
    pairs times lags numbers are shuffled. Values are centred first, which keeps the sums accurate.
    """
    p = len(signals)
    mean = df.agg(*[F.avg(s).alias(s) for s in signals])
    centred = df.select("gidx", *signals).crossJoin(F.broadcast(mean.select(*[F.col(s).alias(f"_m{s}") for s in signals])))  # one row
    centred = centred.select("gidx", *[(F.col(s) - F.coalesce(f"_m{s}", F.lit(0.0))).alias(s) for s in signals])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gidx")
        x, own = pdf[signals].to_numpy(), pdf["_own"].to_numpy()
        out = []
        for k in range(max_lag + 1):
            at = np.flatnonzero(own & (np.arange(len(x)) >= k))
            now, then = x[at], x[at - k]  # then is k rows before now
            xy, sums = then.T @ now, (then.sum(0), now.sum(0), (then**2).sum(0), (now**2).sum(0))
            for i in range(p):
                for j in range(p):
                    if i != j:
                        out.append((i, j, k, len(at), sums[0][i], sums[1][j], sums[2][i], sums[3][j], xy[i, j]))
        return pd.DataFrame(out, columns=["i", "j", "k", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = halo(centred, max_lag).groupBy("_block").applyInPandas(run, "i int, j int, k int, n long, sx double, sy double, sxx double, syy double, sxy double")
    whole = parts.groupBy("i", "j", "k").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n").cast("double")
    vx, vy = F.col("sxx") / n - (F.col("sx") / n) ** 2, F.col("syy") / n - (F.col("sy") / n) ** 2
    r = F.when((vx > TINY**2) & (vy > TINY**2), F.try_divide(F.col("sxy") / n - F.col("sx") * F.col("sy") / (n * n), F.sqrt(vx * vy)))
    named = F.array(*[F.lit(s) for s in signals])
    # i leads j by k: lag k for i < j, lag -k seen from the pair (j, i)
    lag = F.when(F.col("i") < F.col("j"), F.col("k")).otherwise(-F.col("k"))
    both = whole.where("n > 1").where((F.col("i") < F.col("j")) | (F.col("k") > 0))
    return both.select(named[F.least("i", "j")].alias("signal_a"), named[F.greatest("i", "j")].alias("signal_b"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), lag.alias("lag"), F.coalesce(r, F.lit(0.0)).alias("r"))


def lead_lag(cross: DataFrame, least: float = 0.1) -> DataFrame:
    """(leader, follower, optimal_lag, max_correlation, is_significant) of each pair at its strongest lag, the smallest of equals; weaker than `least` left out. At lag 0 the second leads."""
    best = cross.groupBy("signal_a", "signal_b", "i", "j").agg(F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 12), -F.col("lag"))).alias("b"))
    ahead = F.col("b.lag") > 0
    return (
        best.where(F.abs("b.r") >= least)
        .select(
            F.when(ahead, F.col("signal_a")).otherwise(F.col("signal_b")).alias("leader"),
            F.when(ahead, F.col("signal_b")).otherwise(F.col("signal_a")).alias("follower"),
            F.abs("b.lag").alias("optimal_lag"),
            F.col("b.r").alias("max_correlation"),
            (F.abs("b.r") > 0.2).alias("is_significant"),
            "i",
            "j",
        )
        .orderBy(F.desc(F.abs("max_correlation")), "i", "j")
        .drop("i", "j")
    )


def predictive_decay(long: DataFrame, lags: list[int] | None = None, least_pairs: int = 100) -> DataFrame:
    """(signal, lag, n, r): correlation of the label with the signal `lag` rows earlier, across days; 0 below `least_pairs` pairs or where undefined."""
    lags = sorted(lags or DECAY_LAGS)
    w = block_window("signal")
    rows = halo(long.select("signal", "gidx", "label", "value"), max(lags)).select("signal", "_own", F.col("label").cast("double").alias("_y"), *[(F.lag("value", k).over(w) if k else F.col("value")).alias(f"_x{k}") for k in lags])
    one = rows.where("_own").groupBy("signal").agg(*[e for k in lags for e in (pairs(F.col(f"_x{k}"), F.col("_y")).alias(f"n{k}"), pearson(F.col(f"_x{k}"), F.col("_y")).alias(f"r{k}"))])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"n{k}").alias("n"), F.when(F.col(f"n{k}") >= least_pairs, F.coalesce(f"r{k}", F.lit(0.0))).otherwise(0.0).alias("r")) for k in lags])
    return one.select("signal", F.explode(cells).alias("c")).select("signal", "c.*")


def decay_summary(decay: DataFrame) -> DataFrame:
    """(signal, optimal_lag, max_correlation, half_life): the strongest lag (the first of equals) and the first listed lag below half of it, else the last. All zero: the last."""
    top = F.max(F.abs("r"))
    best = decay.groupBy("signal").agg(top.alias("_top"), F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 12), -F.col("lag"))).alias("b"), F.max("lag").alias("_last"))
    half = decay.join(F.broadcast(best.select("signal", "_top")), "signal").where(F.abs("r") < F.col("_top") / 2).groupBy("signal").agg(F.min("lag").alias("_half"))
    return best.join(half, "signal", "left").select("signal", F.col("b.lag").alias("optimal_lag"), F.col("b.r").alias("max_correlation"), F.coalesce("_half", "_last").alias("half_life"))


def level_vs_change(long: DataFrame, back: int = 10, least: int = 100) -> DataFrame:
    """(signal, level_r, change_r, level_auc, change_auc, recommendation): the value against its change over `back` rows (from the first row where there are fewer). Score |r| + (AUC - 0.5), better by 1.2 times wins."""
    w = block_window("signal")
    first = long.groupBy("signal").agg(F.min_by("value", "gidx").alias("_first"))
    rows = halo(long.select("signal", "gidx", "label", "value"), back).withColumn("_was", F.lag("value", back).over(w)).where("_own").join(F.broadcast(first), "signal")
    return compare(rows.select("signal", "label", F.col("value").alias("level"), (F.col("value") - F.coalesce("_was", "_first")).alias("change")), least)


def compare(rows: DataFrame, least: int = 100) -> DataFrame:
    """The comparison of level_vs_change for rows (signal, label, level, change)."""
    from .predictive import labelled, rank_metrics

    kinds = [F.struct(F.concat(F.col("signal"), F.lit(f"\t{k}")).alias("signal"), F.col(k).alias("value")) for k in ("level", "change")]
    both = rows.select("label", F.explode(F.array(*kinds)).alias("x")).select("label", "x.*")
    r = both.groupBy("signal").agg(F.count("*").alias("n"), F.coalesce(pearson(F.col("value"), F.col("label").cast("double")), F.lit(0.0)).alias("r"))
    got = r.join(rank_metrics(labelled(both)), "signal").select(F.split("signal", "\t")[0].alias("signal"), F.split("signal", "\t")[1].alias("kind"), "n", "r", "auc_up")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = got.groupBy("signal").agg(F.max("n").alias("n"), pick("level", "r").alias("level_r"), pick("change", "r").alias("change_r"), pick("level", "auc_up").alias("level_auc"), pick("change", "auc_up").alias("change_auc"))
    score = lambda k: F.abs(f"{k}_r") + (F.col(f"{k}_auc") - 0.5)
    word = F.when(F.col("n") < least, "insufficient_data").when(score("level") > 1.2 * score("change"), "level").when(score("change") > 1.2 * score("level"), "change").otherwise("both")
    return wide.select("signal", "level_r", "change_r", "level_auc", "change_auc", word.alias("recommendation"))


def persistence(long: DataFrame, max_lag: int = 100) -> DataFrame:
    """(signal, half_life, decay_rate, reading, persistence): the autocorrelation's summary in words: very short to 5 rows, short to 20, medium to 50, else long."""
    h = F.col("half_life")
    return acf_reading(autocorrelation(long, max_lag)).withColumn("persistence", F.when(h <= 5, "very short").when(h <= 20, "short").when(h <= 50, "medium").otherwise("long"))


def temporal_summary(df: DataFrame, signals: list[str], max_acf_lag: int = 100, max_lag: int = 20) -> dict:
    """Half-lives, lead-lag pairs, decays and level/change, with the look-back and whether a sequence model is justified. Small results only."""
    from .frames import long_form

    long = long_form(df, signals)
    acf = persistence(long, max_acf_lag).collect()
    leads = lead_lag(cross_correlation(df, signals, max_lag)).collect()
    decays = decay_summary(predictive_decay(long)).collect()
    mean_half = float(np.mean([r.half_life for r in acf])) if acf else 0.0
    return {
        "autocorrelations": [r.asDict() for r in acf],
        "lead_lag": [r.asDict() for r in leads],
        "decays": [r.asDict() for r in decays],
        "level_vs_change": [r.asDict() for r in level_vs_change(long).collect()],
        "optimal_lookback": max(50, min(int(2 * mean_half), max_acf_lag)),
        "sequence_model_justified": mean_half > 10 or any(r.half_life > 10 for r in decays) or any(r.is_significant for r in leads),
    }

