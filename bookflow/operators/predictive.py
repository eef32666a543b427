"""Predictive power of signals for labels: correlation, ranks, AUC, mutual information, binned probabilities, groups.

Ranks come from distinct values with their counts (frames.ranked), so ties cost nothing and a signal of any
length is spread over its value buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation_p_udf, digamma, finite, is_finite, pairs, pearson
from .frames import BUCKETS, exact_quantiles, ranked, value_bucket

_LABELS = {"n_down": -1, "n_stable": 0, "n_up": 1}


def labelled(long: DataFrame) -> DataFrame:
    """Ranked values with their rows per label; rows without label are left out."""
    return ranked(long.where("label is not null"), {k: F.col("label") == v for k, v in _LABELS.items()})


def rank_metrics(values: DataFrame) -> DataFrame:
    """(signal, spearman_r, auc_up, auc_down) from labelled values. An AUC without both classes is 0.5."""
    n, mid = F.col("n"), F.col("before") + (F.col("n") + 1) / 2.0
    sums = values.groupBy("signal").agg(
        F.sum("n").alias("_n"),
        F.sum(n * mid * mid).alias("_sq"),
        *[F.sum(k).alias(f"_{k}") for k in _LABELS],
        *[F.sum(mid * F.col(k)).alias(f"_s{k}") for k in _LABELS],
    )
    centre = (F.col("_n") + 1) / 2.0
    below, xy, yy = F.lit(0), F.lit(0.0), F.lit(0.0)
    for k in _LABELS:  # mid-ranks of the labels
        own = F.col(f"_{k}")
        y = below + (own + 1) / 2.0 - centre
        xy, yy, below = xy + y * (F.col(f"_s{k}") - centre * own), yy + own * y * y, below + own
    xx = F.col("_sq") - F.col("_n") * centre * centre
    spearman = F.when((xx > 0) & (yy > 0), F.try_divide(xy, F.sqrt(xx * yy)))

    def auc(ranks: str, own: str, turned: bool) -> Column:
        m = F.col(own).cast("double")
        rest = F.col("_n") - m
        a = F.try_divide(F.col(ranks) - m * (m + 1) / 2, m * rest)
        return F.coalesce(1 - a if turned else a, F.lit(0.5))

    return sums.select("signal", spearman.alias("spearman_r"), auc("_sn_up", "_n_up", False).alias("auc_up"), auc("_sn_down", "_n_down", True).alias("auc_down"))


def signal_metrics(long: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """Per signal over finite values with labels: n, Pearson and Spearman with p, AUC up and down, mutual information, sign consistency, mean value by label."""
    v, y = finite(F.col("value")), F.col("label").cast("double")
    linear = long.groupBy("signal").agg(pairs(v, y).alias("n_samples"), pearson(v, y).alias("pearson_r"), *[F.avg(F.when(F.col("label") == k, v)).alias(f"mean_{s}") for k, s in ((1, "up"), (0, "stable"), (-1, "down"))])
    out = linear.join(rank_metrics(labelled(long)), "signal", "left").join(mutual_information(long), "signal", "left")
    n = F.col("n_samples").cast("double")
    sign = F.lit(None).cast("string")
    for s, e in (expected or {}).items():
        sign = F.when(F.col("signal") == s, F.lit(e)).otherwise(sign)
    ok = F.when(F.col("expected_sign") == "+", F.col("pearson_r") > 0).when(F.col("expected_sign") == "-", F.col("pearson_r") < 0)
    return out.withColumns({"pearson_p": correlation_p_udf("pearson_r", n), "spearman_p": correlation_p_udf("spearman_r", n), "expected_sign": sign}).withColumn("sign_consistent", ok)


def binned_probabilities(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """(signal, bin, n, mean, min, max, p_up, p_down, p_stable) by quantile bins (a, b], the least value in the first; equal edges are one edge. A constant signal has no bins."""
    edges = exact_quantiles(long, [k / n_bins for k in range(n_bins + 1)]).groupBy("signal").agg(F.sort_array(F.collect_set("q")).alias("_e"))  # n_bins + 1 at most
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    rows = long.where(is_finite(F.col("value"))).join(F.broadcast(edges.where(F.size("_e") > 1).select("signal", inner.alias("_i"))), "signal")
    # comparisons are compiled; a filter over the array would be interpreted for each of its entries
    above = sum((F.coalesce((F.get("_i", F.lit(k)) < F.col("value")).cast("int"), F.lit(0)) for k in range(n_bins - 1)), F.lit(0))
    v, n = F.col("value"), F.count("*")
    share = lambda k: F.count_if(F.col("label") == k) / n
    return rows.groupBy("signal", above.alias("bin")).agg(n.alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), share(1).alias("p_up"), share(-1).alias("p_down"), share(0).alias("p_stable"))


def mutual_information(long: DataFrame, k: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """(signal, mi_nats, mi_bits) by the nearest-neighbour estimator for a continuous and a discrete variable (Ross, 2014), not below 0.

    psi(N) + <psi(k)> - <psi(N_y)> - <psi(m)>: a point's radius is the distance to its k-th neighbour of the same
    label, m the points of any label strictly nearer, itself included (of its own value, where the radius is 0).
    Labels of one row are left out; k is at most a label's rows less one. Neighbours in one dimension are
    neighbours in order, so both steps are windows over value buckets with a halo, not a group per signal.
    """
    rows = long.where("label is not null").select("signal", "label", finite(F.col("value")).alias("value")).where("value is not null")
    many = rows.groupBy("signal", "label").agg(F.count("*").alias("_ny")).where("_ny > 1")
    rows = rows.join(F.broadcast(many), ["signal", "label"])
    # positions within (signal, label) in value order, from counts of distinct values: no row is ranked one by one
    spot = rows.select(F.concat_ws("\t", "signal", F.col("label").cast("string")).alias("class"), "value")
    by_class = ranked(spot, by="class", buckets=buckets)
    # a value's k nearest of its class lie among its copies and the k distinct values on either side
    near = _with_neighbours(by_class, k)
    parts = F.split("class", "\t")
    points = near.select(parts[0].alias("signal"), parts[1].cast("int").alias("label"), "value", "n", "radius")
    whole = ranked(rows, buckets=buckets)
    total = rows.groupBy("signal").agg(F.count("*").alias("_total"))
    each = _counts_within(whole, points, buckets).join(F.broadcast(many), ["signal", "label"])
    got = each.groupBy("signal").agg((F.sum(F.col("n") * (digamma(F.least(F.lit(k), F.col("_ny") - 1)) - digamma(F.col("_ny")) - digamma(F.greatest("m", F.lit(1))))) / F.sum("n")).alias("_mean"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("_total")) + F.col("_mean"))
    return got.join(F.broadcast(total), "signal").select("signal", mi.alias("mi_nats"), (mi / 0.6931471805599453).alias("mi_bits"))


def _with_neighbours(values: DataFrame, k: int) -> DataFrame:
    """Adds radius: the distance from a value to its k-th nearest other row of the class (its own copies count).

    The distinct values of a class are dealt into blocks of its order; a block also holds the k values on either side.
    """
    size, place = 65_536, Window.partitionBy("class", "_chunk").orderBy("value")
    # ordinal of a distinct value: chunks of `before`, numbered inside, with the totals of earlier chunks
    chunk = values.withColumn("_chunk", F.floor(F.col("before") / F.lit(size)).cast("long")).withColumn("_k", F.row_number().over(place) - 1)
    sizes = chunk.groupBy("class", "_chunk").agg(F.count("*").alias("_t"))
    earlier = Window.partitionBy("class").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("class", "_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    at = chunk.join(sizes, ["class", "_chunk"]).withColumn("_at", F.col("_base") + F.col("_k"))
    home = lambda shift: F.floor((F.col("_at") + shift) / F.lit(size)).cast("long")
    blocks = at.withColumn("_home", home(0)).withColumn("_block", F.explode(F.array_distinct(F.array(home(-k), home(0), home(k)))))
    w = Window.partitionBy("class", "_block").orderBy("_at")
    sides = [F.struct(F.abs(f("value", d).over(w) - F.col("value")).alias("d"), f("n", d).over(w).alias("c")) for f in (F.lag, F.lead) for d in range(1, k + 1)]
    mine = blocks.withColumn("_near", F.array_sort(F.filter(F.array(*sides), lambda s: s["d"].isNotNull()))).where("_block = _home")
    start = F.struct((F.col("n") - 1).alias("c"), F.lit(0.0).alias("d"))
    step = lambda acc, s: F.when(acc["c"] >= k, acc).otherwise(F.struct((acc["c"] + s["c"]).alias("c"), s["d"].alias("d")))
    return mine.withColumn("radius", F.aggregate("_near", start, step)["d"])


def _counts_within(whole: DataFrame, points: DataFrame, buckets: int) -> DataFrame:
    """(signal, label, value, n, m): the points with m, the rows of the signal at distance below radius of each point, or of its value where radius is 0.

    Both ends of each interval are ranked among the signal's values: ends and values are sorted together in value buckets.
    """
    cuts = whole.groupBy("signal").agg(F.percentile_approx("value", [k / buckets for k in range(1, buckets)], 10_000).alias("_cuts"))
    x, r = F.col("value"), F.col("radius")
    lo = F.struct((x - r).alias("at"), F.when(r > 0, 1).otherwise(-1).alias("side"), F.lit(-1).alias("sign"))  # after values equal to the end, or before them
    hi = F.struct((x + r).alias("at"), F.when(r > 0, -1).otherwise(1).alias("side"), F.lit(1).alias("sign"))
    asked = points.select("signal", "label", "value", F.col("n").alias("_copies"), F.explode(F.array(lo, hi)).alias("e")).select("signal", F.col("e.at").alias("at"), F.col("e.side").alias("side"), F.col("e.sign").alias("sign"), "label", "value", F.lit(0).cast("long").alias("n"), "_copies")
    held = whole.select("signal", F.col("value").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("sign"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("value"), "n", F.lit(None).cast("long").alias("_copies"))
    both = value_bucket(asked.unionByName(held).join(F.broadcast(cuts), "signal"), "_cuts", "at", "_bucket", buckets).drop("_cuts")
    totals = both.groupBy("signal", "_bucket").agg(F.sum("n").alias("_t"))
    earlier = Window.partitionBy("signal").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("signal", "_bucket", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("signal", "_bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_in", F.sum("n").over(inside)).where("sign <> 0").join(totals, ["signal", "_bucket"])
    return seen.groupBy("signal", "label", "value").agg(F.first("_copies").alias("n"), F.sum(F.col("sign") * (F.col("_base") + F.col("_in"))).alias("m"))


def predictive_groups(metrics: DataFrame, matrix: DataFrame | None = None, primary: float = 0.05, low: float = 0.01, redundant: float = 0.5) -> DataFrame:
    """(signal, pearson_r, abs_r, group): redundant, low_priority, contrarian, primary or moderate, in that priority; strongest first.

    Of a pair correlated beyond `redundant` the weaker predictor is redundant, the first of equals.
    """
    own = metrics.select("signal", "pearson_r", "sign_consistent", F.abs("pearson_r").alias("abs_r"))
    if matrix is not None:
        strength = own.select("signal", "abs_r")
        pair = matrix.where((F.col("i") < F.col("j")) & (F.abs("r") > redundant))
        a, b = strength.withColumnsRenamed({"signal": "signal_a", "abs_r": "_a"}), strength.withColumnsRenamed({"signal": "signal_b", "abs_r": "_b"})
        worse = pair.join(a, "signal_a").join(b, "signal_b").select(F.when(F.col("_a") <= F.col("_b"), F.col("signal_a")).otherwise(F.col("signal_b")).alias("signal"))
        own = own.join(worse.distinct().withColumn("_redundant", F.lit(True)), "signal", "left")
    else:
        own = own.withColumn("_redundant", F.lit(None).cast("boolean"))
    r = F.col("abs_r")
    group = (
        F.when(F.col("_redundant"), "redundant")
        .when(r < low, "low_priority")
        .when(F.col("sign_consistent") == F.lit(False), "contrarian")
        .when(r >= primary, "primary")
        .otherwise("moderate")
    )
    return own.select("signal", "pearson_r", "abs_r", group.alias("group")).orderBy(F.desc("abs_r"), "signal")
