"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b) of longs; component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). A node with very many neighbours is
    handled by partial minima and by joins that Spark may split, never gathered into one task. Each round
    is checkpointed, so a lost executor costs one round at most. Self loops and nulls are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = checkpoint(e), None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen[0] == 0 or seen == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = seen
        e = checkpoint(_small_star(_large_star(e)))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels (labels[k] <= k, a union-find forest) with the links i-j added, fully compressed."""
    while i.size:
        a, b = labels[i], labels[j]
        keep = a != b
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels
