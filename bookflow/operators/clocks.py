"""Samples and labels on clocks of their own: label i belongs to the sample i * stride + window - 1.

Both tables are numbered by position (gidx for samples, i for labels; per `by` where given). A lag is then an exact distance
between positions, whatever rows lie between, and a window is put together from panes, so that neither the number of lags
nor the overlap of windows multiplies the rows that are moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pairs, pearson
from .frames import BLOCK, halo
from .temporal import DECAY_LAGS, compare

WINDOW, STRIDE = 100, 10


def with_position(df: DataFrame, bucket: Column, order: list[str], by: tuple[str, ...] = (), out: str = "gidx") -> DataFrame:
    """Adds out: positions from 0 along `order` within `by`. bucket never falls along the order; rows are numbered within it, and only bucket sizes are summed in order."""
    tagged = df.withColumn("_b", bucket)
    sizes = tagged.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = tagged.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1)
    own = F.col("_b").eqNullSafe(F.col("_s"))
    for c in by:
        own = own & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(starts, own).withColumn(out, F.col("_start") + F.col("_k")).drop("_b", "_k", "_s", "_start", *[f"_{c}" for c in by])


def clock(samples: DataFrame, labels: DataFrame, window: int = WINDOW, stride: int = STRIDE) -> tuple[int, int]:
    """(window, stride) as given, or (1, 1) where there are as many labels as samples: then they are aligned row by row."""
    return (1, 1) if samples.count() == labels.count() else (window, stride)


def looked_back(samples: DataFrame, labels: DataFrame, signals: list[str], lags: list[int], window: int = WINDOW, stride: int = STRIDE, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """A row per label (by, i, label) with `<signal>_<lag>`: the sample `lag` positions before the label's own; null where there is none.

    Labels are laid among the samples at their positions, in blocks with a halo as long as the longest lag. All lags are
    frames of one window: samples are moved and sorted once.
    """
    at = F.col("i") * stride + (window - 1)
    rows = halo(samples.select(*by, "gidx", *[F.col(s).cast("double").alias(s) for s in signals]), max(lags), block)
    rows = rows.withColumns({"i": F.lit(None).cast("long"), "label": F.lit(None).cast("int")})
    ends = labels.select(*by, at.cast("long").alias("gidx"), *[F.lit(None).cast("double").alias(s) for s in signals], F.floor(at / F.lit(block)).cast("long").alias("_block"), F.lit(True).alias("_own"), F.col("i").cast("long").alias("i"), F.col("label").cast("int").alias("label"))
    w = Window.partitionBy(*by, "_block").orderBy("gidx")
    both = rows.unionByName(ends)
    found = both.select(*by, "i", "label", *[F.max(s).over(w.rangeBetween(-k, -k)).alias(f"{s}_{k}") for s in signals for k in lags])
    return found.where("i is not null")


def decay(samples: DataFrame, labels: DataFrame, signals: list[str], lags: list[int] | None = None, least_pairs: int = 100, window: int = WINDOW, stride: int = STRIDE, by: tuple[str, ...] = ()) -> DataFrame:
    """(signal, lag, n, r): correlation of labels with the samples `lag` positions before theirs; 0 below `least_pairs` pairs or where undefined."""
    lags = sorted(lags or DECAY_LAGS)
    y = F.col("label").cast("double")
    rows = looked_back(samples, labels, signals, lags, window, stride, by)
    one = rows.agg(*[e for s in signals for k in lags for e in (pairs(F.col(f"{s}_{k}"), y).alias(f"n_{s}_{k}"), pearson(F.col(f"{s}_{k}"), y).alias(f"r_{s}_{k}"))])
    r = lambda s, k: F.when(F.col(f"n_{s}_{k}") >= least_pairs, F.coalesce(f"r_{s}_{k}", F.lit(0.0))).otherwise(0.0)
    cells = [F.struct(F.lit(s).alias("signal"), F.lit(k).alias("lag"), F.col(f"n_{s}_{k}").alias("n"), r(s, k).alias("r")) for s in signals for k in lags]
    return one.select(F.inline(F.array(*cells)))


def panes(long: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, signal, gidx, rows, n, first, last, low, high, mean, var) of every `width` positions; here gidx is the pane's position."""
    v = F.col("value")
    return long.groupBy(*by, "signal", F.floor(F.col("gidx") / width).cast("long").alias("pane")).agg(
        F.count("*").alias("rows"), F.count(v).alias("n"), F.min_by("value", "gidx").alias("first"), F.max_by("value", "gidx").alias("last"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.var_pop(v).alias("var")
    ).withColumnRenamed("pane", "gidx")


def windows(long: DataFrame, window: int = WINDOW, stride: int = STRIDE, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(by, signal, i, n, start, end, low, high, mean, std) of the windows of `window` positions that start every `stride`; those cut short by the end are left out.

    Rows are reduced to panes of gcd(window, stride) positions, with partial aggregates before the shuffle; overlapping windows
    then share panes, in blocks of panes with a halo.
    """
    width = math.gcd(window, stride)
    span, every = window // width, stride // width
    own = Window.partitionBy(*by, "signal", "_block")
    w = own.orderBy("gidx").rangeBetween(1 - span, 0)
    placed = halo(panes(long, width, by), span - 1, block)
    # means are taken from a value near them, so that no digits go where they are much larger than the spread
    placed = placed.withColumn("_o", F.coalesce(F.min("mean").over(own), F.lit(0.0))).withColumn("_d", F.col("mean") - F.col("_o"))
    n = F.sum("n").over(w)
    off = F.try_divide(F.sum(F.col("n") * F.col("_d")).over(w), n)
    square = F.try_divide(F.sum(F.col("n") * (F.col("var") + F.col("_d") * F.col("_d"))).over(w), n)
    full = placed.select(*by, "signal", "gidx", "_own", "_o", F.sum("rows").over(w).alias("_rows"), n.alias("n"), F.first("first").over(w).alias("start"), F.col("last").alias("end"), F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"), off.alias("_off"), square.alias("_square"))
    head = F.col("gidx") - (span - 1)
    full = full.where(F.col("_own") & (F.col("_rows") == window) & (head >= 0) & (head % every == 0))
    std = F.sqrt(F.greatest(F.col("_square") - F.col("_off") * F.col("_off"), F.lit(0.0)))
    return full.select(*by, "signal", (head / every).cast("long").alias("i"), "n", "start", "end", "low", "high", (F.col("_o") + F.col("_off")).alias("mean"), std.alias("std"))


def level_vs_change(long: DataFrame, labels: DataFrame, window: int = WINDOW, stride: int = STRIDE, least: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """(signal, level_r, change_r, level_auc, change_auc, recommendation): the last value of a label's window against its change from the window's start."""
    ends = windows(long, window, stride, by).select(*by, "i", "signal", "start", "end")
    rows = ends.join(labels.select(*by, F.col("i").cast("long").alias("i"), "label"), [*by, "i"])
    return compare(rows.select("signal", "label", F.col("end").alias("level"), (F.col("end") - F.col("start")).alias("change")), least)
