"""Order, lags and ranks: what the analyses have in common.

The canonical frame has a row per sample: date, seq (0-based in the day), gidx (0-based over all days),
label, regime and a double column per signal. Order is a column, never a row's place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import is_finite

#: Rows of a block of the global order; a lag window is partitioned by block.
BLOCK = 65_536
#: Value buckets a signal; a rank window is partitioned by bucket.
BUCKETS = 256


def with_gidx(df: DataFrame) -> DataFrame:
    """Adds gidx, the position over all days in date order, from seq and the table of day sizes. The window runs over days, not rows."""
    days = df.groupBy("date").agg(F.count("*").alias("_n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return df.join(days, "date").withColumn("gidx", F.col("_start") + F.col("seq")).drop("_start")


def long_form(df: DataFrame, signals: list[str], keys: tuple[str, ...] = ("date", "seq", "gidx", "label", "regime")) -> DataFrame:
    """A row per sample and signal: the keys that df has, signal, value."""
    ids = [k for k in keys if k in df.columns]
    return df.select(*ids, *[F.col(s).cast("double").alias(s) for s in signals]).unpivot(ids, signals, "signal", "value")


def day_window(*more: str) -> Window:
    return Window.partitionBy("date", *more).orderBy("seq")


def halo(df: DataFrame, history: int, block: int = BLOCK) -> DataFrame:
    """df with _block and _own: each block of the global order also holds the `history` rows before it, not its own.

    Lags over (_block ordered by gidx) are then exact across blocks and days, and no window holds more than a block.
    """
    if history > block:
        raise ValueError("history is longer than a block")
    own = F.floor(F.col("gidx") / F.lit(block)).cast("long")
    twice = F.when(F.col("gidx") % block >= block - history, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(twice)).withColumn("_own", F.col("_block") == own)


def block_window(*more: str) -> Window:
    return Window.partitionBy("_block", *more).orderBy("gidx")


def aligned(samples: DataFrame, labels: DataFrame, window: int = 100, stride: int = 10, keep_equal: bool = False) -> DataFrame:
    """Label i of a day with the sample i * stride + window - 1, clamped to the day's last one.

    samples (split, date, seq, ...) and labels (split, date, seq, label...). With keep_equal a day with as many labels as samples is aligned row by row.
    """
    key = ["split", "date"]
    n_samples = samples.groupBy(*key).agg(F.count("*").alias("_n"))
    n_labels = labels.groupBy(*key).agg(F.count("*").alias("_m"))
    at = F.least(F.col("_i") * stride + (window - 1), F.col("_n") - 1)
    if keep_equal:
        at = F.when(F.col("_n") == F.col("_m"), F.col("_i")).otherwise(at)
    wanted = labels.withColumnRenamed("seq", "_i").join(n_samples, key).join(n_labels, key).withColumn("_at", at).drop("_n", "_m")
    found = wanted.join(samples.withColumnRenamed("seq", "_at"), [*key, "_at"])
    return found.withColumnRenamed("_i", "seq").drop("_at")


def value_bucket(df: DataFrame, cuts: str, value: str, out: str, buckets: int) -> DataFrame:
    """Adds out: how many of the ascending cuts (buckets - 1 of them, buckets a power of two) are below the value.

    A binary search, one compiled projection a step; a filter over the array would be interpreted for each of its entries.
    """
    df, step = df.withColumn(out, F.lit(0)), buckets // 2
    while step:
        df = df.withColumn(out, F.col(out) + F.when(F.get(cuts, F.col(out) + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return df


def ranked(long: DataFrame, counts: dict[str, Column] | None = None, by: str = "signal", buckets: int = BUCKETS) -> DataFrame:
    """(by, value, n, counts..., before): distinct finite values with how many rows have them, and how many a smaller one.

    Equal values are added up before anything is sorted, and running sums are taken within value buckets whose
    totals are then summed, so that neither a frequent value nor a long signal lands in one task.
    """
    counts = counts or {}
    rows = long.where(is_finite(F.col("value")))
    values = rows.groupBy(by, "value").agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in counts.items()])
    cuts = values.groupBy(by).agg(F.percentile_approx("value", [k / buckets for k in range(1, buckets)], 10_000).alias("_cuts"))
    placed = value_bucket(values.join(F.broadcast(cuts), by), "_cuts", "value", "_bucket", buckets).drop("_cuts")
    totals = placed.groupBy(by, "_bucket").agg(F.sum("n").alias("_t"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "_bucket", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, [by, "_bucket"])
    return placed.withColumn("before", F.col("_base") + F.col("_in")).drop("_base", "_in", "_bucket")


def quantiles(values: DataFrame, probabilities: list[float], by: str = "signal") -> DataFrame:
    """(by, p, q): exact quantiles by linear interpolation, from ranked values."""
    total = values.groupBy(by).agg(F.sum("n").alias("_n"))
    place = total.select(by, F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"), (F.col("p") * (F.col("_n") - 1)).alias("_at"))
    ends = place.select(by, "p", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_k"))
    # as many rows as signals times probabilities
    held = values.join(F.broadcast(ends), by).where((F.col("_k") >= F.col("before")) & (F.col("_k") < F.col("before") + F.col("n")))
    two = held.groupBy(by, "p", "_at").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return two.select(by, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("q"))


#: Accuracy of the sketch that brackets quantiles (its rank error is 1/ACCURACY of the rows), and the most rows of a bracket that are sorted.
ACCURACY, BRACKET = 10_000, 1_000_000


class _Brackets:
    """Disjoint stretches of values of each key; cuts are such that a row is inside a stretch if an odd number of them is below it."""

    def __init__(self, spark: SparkSession, by: str, stretches: dict[str, list[tuple[float, float]]]):
        self.of: dict[str, list[tuple[float, float]]] = {}
        for key, found in stretches.items():
            own: list[tuple[float, float]] = []
            for lo, hi in sorted(found):
                if own and lo <= own[-1][1]:
                    own[-1] = own[-1][0], max(own[-1][1], hi)
                else:
                    own.append((lo, hi))
            self.of[key] = own
        most = max((len(x) for x in self.of.values()), default=0)
        self.buckets = 1 << (2 * most).bit_length()
        cuts = {key: [c for lo, hi in own for c in (math.nextafter(lo, -math.inf), hi)] for key, own in self.of.items()}
        rows = [(key, x + [math.inf] * (self.buckets - 1 - len(x))) for key, x in cuts.items()]
        self.table = spark.createDataFrame(rows, f"{by} string, _cuts array<double>")
        self.by = by

    def place(self, rows: DataFrame) -> DataFrame:
        """rows (by, value) with `_at`, the number of cuts below."""
        return value_bucket(rows.join(F.broadcast(self.table), self.by), "_cuts", "value", "_at", self.buckets).drop("_cuts")

    def counts(self, rows: DataFrame) -> dict[str, list[int]]:
        """Rows between the cuts. A number a key and cut comes back."""
        out = {key: [0] * self.buckets for key in self.of}
        for r in self.place(rows).groupBy(self.by, "_at").agg(F.count("*").alias("n")).collect():
            out[r[self.by]][r["_at"]] = r["n"]
        return out


def exact_quantiles(long: DataFrame, probabilities: list[float], by: str = "signal", accuracy: int = ACCURACY, bracket: int = BRACKET) -> DataFrame:
    """(by, p, q): exact quantiles by linear interpolation of the finite values, without sorting or shuffling all of them.

    A mergeable sketch brackets each quantile; a second scan counts the rows below and inside the brackets; where a bracket still holds more
    than `bracket` rows, a sketch of its rows alone narrows it. Only values inside brackets, a few ten-thousandths of the rows, are
    then grouped and ranked. If a count shows that a bracket has missed its rank it is opened to the extremes, so the result
    does not rest on the sketch. Collected are a few numbers a key and probability.
    """
    spark = long.sparkSession
    ps = sorted({float(p) for p in probabilities})
    rows = long.where(is_finite(F.col("value"))).select(F.col(by).cast("string").alias(by), F.col("value").cast("double").alias("value"))
    slack = 2.0 / accuracy
    grid = [min(1.0, max(0.0, p + d)) for p in ps for d in (-slack, slack)]
    seen = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile_approx("value", grid, accuracy).alias("g")).collect()
    ends = {r[by]: {p: (math.floor(p * (r.n - 1)), math.ceil(p * (r.n - 1))) for p in ps} for r in seen}
    whole = {r[by]: (r.lo, r.hi) for r in seen}
    stretches = {r[by]: [(r.lo if p <= slack else r.g[2 * k], r.hi if p >= 1 - slack else r.g[2 * k + 1]) for k, p in enumerate(ps)] for r in seen}
    opened: set[str] = set()
    while True:
        own = _Brackets(spark, by, stretches)
        counts = own.counts(rows) if seen else {}
        base = {key: [sum(c[:k]) for k in range(len(c) + 1)] for key, c in counts.items()}
        inside = lambda key, rank: next((k for k in range(1, own.buckets, 2) if base[key][k] <= rank < base[key][k + 1]), None)  # noqa: B023, E731
        lost = {key for key, e in ends.items() if any(inside(key, r) is None for two in e.values() for r in two)}
        wide = {(key, k) for key, c in counts.items() for k in range(1, own.buckets, 2) if c[k] > bracket and key not in opened}
        if lost:
            opened |= lost
            stretches = {key: [whole[key]] if key in lost else own.of[key] for key in own.of}
            continue
        if not wide:
            break
        fine = [j / 1024 for j in range(1025)]
        inner = {}
        for r in own.place(rows).where(F.col("_at") % 2 == 1).groupBy(by, "_at").agg(F.percentile_approx("value", fine, accuracy).alias("g")).collect():
            inner[r[by], r["_at"]] = r.g
        before = dict(own.of)
        stretches = {key: [] for key in before}
        for key, e in ends.items():
            for rank in {r for two in e.values() for r in two}:
                k = inside(key, rank)
                lo, hi = before[key][k // 2]
                if (key, k) in wide:
                    at = (rank - base[key][k]) / counts[key][k] * 1024
                    a, b = math.floor(at) - 2, math.ceil(at) + 2
                    lo, hi = inner[key, k][a] if a > 0 else lo, inner[key, k][b] if b < 1024 else hi
                stretches[key].append((lo, hi))
        if {key: _Brackets(spark, by, {key: x}).of[key] for key, x in stretches.items()} == before:
            break  # one value fills the bracket
    starts = spark.createDataFrame([(key, k, base[key][k]) for key in own.of for k in range(1, own.buckets, 2)], f"{by} string, _at int, _base long")
    held = own.place(rows).where(F.col("_at") % 2 == 1).groupBy(by, "_at", "value").agg(F.count("*").alias("n")).join(F.broadcast(starts), [by, "_at"])
    before = F.col("_base") + F.coalesce(F.sum("n").over(Window.partitionBy(by, "_at").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = spark.createDataFrame([(key, p, p * (r.n - 1), k) for r in seen for key in [r[by]] for p in ps for k in sorted(set(ends[key][p]))], f"{by} string, p double, _place double, _k long")
    hit = held.withColumn("_before", before).join(F.broadcast(wanted), by).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("n")))
    two = hit.groupBy(by, "p", "_place").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return two.select(by, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_place") - F.floor("_place"))).alias("q"))
