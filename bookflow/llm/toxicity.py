"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (`SIZES`, lower case, white space runs as one space, a space at both ends)
that it holds at least 1, 2 and 4 times (`LEVELS`), each a feature of presence; n-grams are hashed into `BUCKETS`. Whole
texts are read, in stretches that overlap by the longest n-gram.

* Ratios: over all labelled training documents Spark counts in how many of each label a feature occurs;
  r = log((p + 1) / (P + 2)) - log((n + 1) / (N + 2)). A task adds up two vectors of `BUCKETS` x `LEVELS` numbers.
* Features kept: the `FEATURES` whose presence and label depend on each other most (likelihood ratio statistic),
  seen in at least `LOW` documents.
* Weights: logistic regression with a squared penalty on features scaled by r, by accelerated gradient descent on at most
  `QUOTA` documents of each label, chosen by a hash of their ids and weighted to stand for all. That sample is the only bound.

A document's score is the logistic function of its features' weights and the bias.

Rules: labels are read for documents with an id whose crc32 as text, modulo 4, is not 2; a document with several
label rows is toxic if one says 1, values other than 0 and 1 are ignored; a null id is not held out and not learned from; repeated
documents are learned from and scored each; null text is empty text, which gets the bias; where there are no labelled documents
of both kinds every score is their share of label 1 (0 if there are none); other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .langid import held_out

SIZES, LEVELS, BITS, FEATURES, LOW, QUOTA, STEPS, PENALTY = (4, 5), (1, 2, 4), 18, 4096, 4, 1500, 200, 1e-3
BUCKETS = 1 << BITS
SPACE = BUCKETS * len(LEVELS)
STRETCH = 1 << 20
THRESHOLD = 0.3
#: Label tables up to so many rows (16 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_SPACES = re.compile(r"\s+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """The features of a text: each bucket of its n-grams at each level that its count reaches."""
    whole = f" {_SPACES.sub(' ', (text or '').lower()).strip(' ')} "
    total = None
    for a in range(0, len(whole), STRETCH):
        chars = np.frombuffer(whole[a : a + STRETCH + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        parts = []
        h = np.zeros(len(chars), np.uint64)
        for n in range(1, max(SIZES) + 1):
            if len(chars) < n:
                break
            h = h[: len(chars) - n + 1] * _PRIME + chars[n - 1 :] + np.uint64(n)
            if n in SIZES:
                # n-grams that start in the stretch
                parts.append((h[:STRETCH] * _PRIME >> np.uint64(64 - BITS)).astype(np.int64))
        new = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if len(whole) > 1 << 16:
            total = (0 if total is None else total) + np.bincount(new, minlength=BUCKETS)
    at, count = np.unique(new, return_counts=True) if total is None else (np.flatnonzero(total), total[total > 0])
    return np.concatenate([at[count >= level] * len(LEVELS) + k for k, level in enumerate(LEVELS)])


class Model:
    """Kept features with their weights, and the bias."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.weight = np.zeros(SPACE)
        self.weight[kept] = weights
        self.bias = bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weight[features(text)].sum())
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def constant(share: float) -> Model:
    """The model that gives every text that score."""
    none = np.zeros(0, np.int64)
    return Model(none, none.astype(float), float(np.log(share / (1 - share))) if 0 < share < 1 else 800.0 * (share >= 1) - 800.0 * (share <= 0))


def dependence(pos: np.ndarray, neg: np.ndarray, p: float, n: float) -> np.ndarray:
    """The likelihood ratio statistic of presence and label."""
    cells = [(pos, pos + neg, p), (neg, pos + neg, n), (p - pos, p + n - pos - neg, p), (n - neg, p + n - pos - neg, n)]
    return sum(2 * x * np.log(np.maximum(x, 1e-12) * (p + n) / np.maximum(row * col, 1e-12)) for x, row, col in cells)


def fit(docs: list[np.ndarray], y: np.ndarray, importance: np.ndarray, ratio: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of presence (each times its ratio) and bias. docs: the positions of each document's features."""
    col = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    value = ratio[col]
    part = importance / importance.sum()
    # a bound of the curvature: a quarter of the weighted squares' sum over documents
    squares = np.bincount(row, value * value, len(docs)) + 1
    step = 1 / (0.25 * float(part @ squares) + PENALTY)
    w, b, v, c, momentum = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0, 1.0
    for _ in range(steps):
        z = np.bincount(row, value * v[col], len(docs)) + c
        g = part * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        new_w = v - step * (np.bincount(col, value * g[row], len(ratio)) + PENALTY * v)
        new_b = c - step * float(g.sum())
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, c = new_w + (momentum - 1) / following * (new_w - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w * ratio, b


def labelled(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, text, y) of the training documents. docs: (doc_id, text)."""
    of = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").where(~held_out("id", 4, 2))
    of = of.groupBy("id").agg(F.max("y").alias("y"))
    of = F.broadcast(of) if labels.count() <= BROADCAST_ROWS else of
    return docs.where("doc_id is not null").where(~held_out("doc_id", 4, 2)).join(of, F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, neg, pos) a task; feature -1 counts the documents."""
    held = np.zeros((2, SPACE + 1), np.int64)
    for b in slices(batches):
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            held[y, features(text) + 1] += 1
            held[y, 0] += 1
    at = np.flatnonzero(held.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(held[0, at]), pa.array(held[1, at])], ["feature", "neg", "pos"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quota: int = QUOTA) -> Model:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = labelled(own, labels, label_col)
    got = rows.select("text", "y").mapInArrow(_presence, "feature long, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow().sort_by("feature")
    at, neg, pos = (got.column(c).to_numpy() for c in ("feature", "neg", "pos"))
    if not len(at) or at[0] >= 0:
        return constant(0.0)
    n, p = float(neg[0]), float(pos[0])
    if not n or not p:
        return constant(p / (n + p))
    at, neg, pos = at[1:], neg[1:].astype(float), pos[1:].astype(float)
    often = np.flatnonzero(neg + pos >= LOW)
    best = often[np.argsort(-dependence(pos[often], neg[often], p, n), kind="stable")[:FEATURES]]
    best.sort()
    kept, ratio = at[best], np.log((pos[best] + 1) / (p + 2)) - np.log((neg[best] + 1) / (n + 2))
    place = np.full(SPACE, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shared.value[features(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x[x >= 0].astype("<i4").tobytes() for x in found], pa.binary())], ["doc_id", "y", "at"])

    share = F.when(F.col("y") == 1, F.lit(min(1.0, quota / p))).otherwise(F.lit(min(1.0, quota / n)))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(lot < share).mapInArrow(numbered, "doc_id long, y int, at binary")
    got = sorted((r.doc_id, r.y, bytes(r.at)) for r in sample.collect())
    y = np.array([x[1] for x in got])
    if not len(y) or y.min() == y.max():
        return constant(p / (n + p))
    stands_for = np.where(y == 1, p / (y == 1).sum(), n / (y == 0).sum())
    weights, bias = fit([np.frombuffer(x[2], "<i4").astype(np.int64) for x in got], y, stands_for, ratio)
    return Model(kept, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shared.value.score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
