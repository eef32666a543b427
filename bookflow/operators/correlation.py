"""Correlation structure of signals: matrix, redundancy, principal components, variance inflation, clusters.

The data is read once, in one aggregate of all pairs; what follows works on the p x p matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TINY, finite, pearson
from .quality import complete_cases


def correlation_matrix(df: DataFrame, signals: list[str], fill: bool = False) -> DataFrame:
    """(i, j, signal_a, signal_b, r) for i <= j; null r where either is constant (0 with fill). NaN spreads."""
    cols = [(i, j, pearson(F.col(a).cast("double"), F.col(b).cast("double"))) for i, a in enumerate(signals) for j, b in enumerate(signals) if i <= j]
    one = df.agg(*[c.alias(f"c{i}_{j}") for i, j, c in cols])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(signals[i]).alias("signal_a"), F.lit(signals[j]).alias("signal_b"), F.col(f"c{i}_{j}").alias("r")) for i, j, _ in cols])
    out = one.select(F.explode(cells).alias("x")).select("x.*")
    return out.fillna(0.0, ["r"]) if fill else out


def redundant_pairs(matrix: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs i < j with |r| above the threshold, strongest first."""
    return matrix.where((F.col("i") < F.col("j")) & (F.abs("r") > threshold)).orderBy(F.desc(F.abs("r")), "i", "j")


def _matrix(df: DataFrame, signals: list[str]) -> tuple[np.ndarray, int]:
    """The correlation matrix over complete cases, a constant signal's row and column zero; and the cases.

    One scan for the means, one for the products around them: each task adds up a matrix over its Arrow batches, so the
    plan has a row per cell and not an expression per pair.
    """
    whole = complete_cases(df, signals).select(*[F.col(s).cast("double").alias(s) for s in signals])
    first = whole.agg(F.count("*"), *[F.avg(s) for s in signals]).first()
    n = first[0]
    if n < 100:
        raise ValueError(f"{n} complete rows are too few; 100 are needed")
    mean, size = np.array(first[1:], float), len(signals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((size, size))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) - mean
            held += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(held.ravel())], ["cell", "v"])

    cells = whole.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # size^2
    gram = np.zeros(size * size)
    for r in cells:
        gram[r.cell] = r.v
    gram = gram.reshape(size, size)
    spread = np.sqrt(np.diagonal(gram) / n)
    scale = np.where(spread >= TINY, spread * math.sqrt(n), np.inf)
    out = gram / np.outer(scale, scale)
    out[np.diag_indices(size)] = (spread >= TINY).astype(float)
    return out, n


def pca(df: DataFrame, signals: list[str], n_components: int | None = None) -> DataFrame:
    """(component, explained, cumulative, loadings, dominant) of standardized complete cases. A component's largest loading is positive."""
    r, _ = _matrix(df, signals)
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(-values, kind="stable")
    total, rows, cumulative = max(values.sum(), 1e-300), [], 0.0
    for k, at in enumerate(order[: n_components or len(signals)]):
        v = vectors[:, at]
        top = int(np.abs(v).argmax())
        v = v * np.sign(v[top])
        cumulative += values[at] / total
        rows.append((k, float(max(values[at], 0.0) / total), float(cumulative), [float(x) for x in v], signals[top]))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double, loadings array<double>, dominant string")


def components_needed(explained: list[float], share: float) -> int:
    """Components whose cumulative share reaches `share`; one more than there are if none does."""
    return int(np.searchsorted(np.cumsum(explained) + 1e-12, share)) + 1


def vif(df: DataFrame, signals: list[str]) -> DataFrame:
    """(signal, vif, is_problematic, is_severe): 1 / (1 - R^2) of each signal on the others; a constant has 1, an (almost) exact fit 100 and both flags."""
    r, _ = _matrix(df, signals)
    rows = []
    for i, s in enumerate(signals):
        rest = [k for k in range(len(signals)) if k != i and r[k, k] > 0]
        fit = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], hermitian=True) @ r[rest, i]) if rest and r[i, i] > 0 else 0.0
        v = float("inf") if fit >= 0.9999 else 1 / (1 - max(fit, 0.0))
        rows.append((s, 100.0 if np.isinf(v) else v, v > 5, v > 10))
    return df.sparkSession.createDataFrame(rows, "signal string, vif double, is_problematic boolean, is_severe boolean")


def clusters(matrix: DataFrame, signals: list[str], threshold: float = 0.5) -> DataFrame:
    """(cluster_id, signals, mean_within): in order, each free signal leads a cluster that the free signals correlated with it beyond the threshold join (not their own followers).

    A recursive query over the matrix's rows: a step takes the first free signal and its free neighbours.
    """
    spark = matrix.sparkSession
    r = matrix.where("i <> j").select("i", "j", F.abs("r").alias("r"))
    both = r.union(r.select("j", "i", "r"))
    # a row a signal: itself and its neighbours
    near = spark.range(len(signals)).select(F.col("id").cast("int").alias("lead")).join(both.where(F.col("r") > threshold), F.col("lead") == F.col("i"), "left")
    near = near.groupBy("lead").agg(F.collect_list("j").alias("near")).select("lead", F.concat(F.array("lead"), "near").alias("near"))
    every = F.sort_array(F.collect_list("lead"))
    steps = f"""
    WITH RECURSIVE c(cluster_id, own, free) MAX RECURSION LEVEL {len(signals) + 1} AS (
      SELECT 0, array_intersect(every, near), array_except(every, near) FROM {{all}} JOIN {{near}} ON lead = 0
      UNION ALL
      SELECT cluster_id + 1, array_intersect(free, near), array_except(free, near) FROM c JOIN {{near}} ON lead = free[0] WHERE size(free) > 0
    ) SELECT cluster_id, own FROM c"""
    own = spark.sql(steps, near=near, all=near.agg(every.alias("every")))
    members = own.select("cluster_id", F.explode("own").alias("k"))
    inner = members.alias("a").join(members.alias("b"), F.expr("a.cluster_id = b.cluster_id and a.k < b.k")).select(F.col("a.cluster_id").alias("_c"), F.col("a.k").alias("_a"), F.col("b.k").alias("_b"))
    # signals without a correlation count as not correlated
    inner = inner.join(both, F.expr("i = _a and j = _b"), "left").groupBy("_c").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("_r"))
    names = F.array(*[F.lit(s) for s in signals])
    named = own.select("cluster_id", F.transform(F.sort_array("own"), lambda k: F.get(names, k)).alias("signals"))
    return named.join(inner, F.col("cluster_id") == F.col("_c"), "left").select("cluster_id", "signals", F.coalesce("_r", F.lit(1.0)).alias("mean_within"))


def finite_correlation(long: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., n, r): correlation of finite signal values with labels."""
    v = finite(F.col("value"))
    return long.groupBy(*by).agg(F.count(F.when(v.isNotNull() & F.col("label").isNotNull(), 1)).alias("n"), pearson(v, F.col("label").cast("double")).alias("r"))
