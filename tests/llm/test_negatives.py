import math
import random

import numpy as np
import pytest

from bookflow.llm import negatives as N


def brute(rows):
    """(anchor, positive, rank, negative, scores), with null ids last among ties and rows in order."""
    ready = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        most = int(((1 << 31) - 1) // math.sqrt(max(1, len(v))))
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        ready.append((k, i, label, [max(-most, min(most, math.floor(256 * x))) for x in v]))
    out = []
    for k, i, label, v in ready:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m, j, other) for m, j, other, w in ready if len(w) == len(v) and m != k), key=lambda x: x[:4])
        for p in [x for x in scored if x[5] == label][:5]:
            hard = [x for x in scored if x[5] != label and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:3]
            out += [(i, p[4], n, x[4], -p[0], -x[0]) for n, x in enumerate(hard, 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def same(spark, monkeypatch, rows, parts=3):
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, row string, v int").repartition(parts)
    monkeypatch.setattr(N, "table", lambda *_: table)
    got = [tuple(r) for r in N.op12(spark, "").collect()]
    assert order(got) == order(brute(rows))
    return got


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in N.op12(spark, sf).collect()]
    assert len(got) > 100 and order(got) == order(brute(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_copies_nulls_and_lengths(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(N, "SEGMENT", 24)
    monkeypatch.setattr(N, "CHUNK", 5)
    monkeypatch.setattr(N, "RUN", 7)
    monkeypatch.setattr(N, "PIVOTS", 6)
    centres = [[r.gauss(0, 4) for _ in range(5)] for _ in range(6)]
    rows = []
    for k in range(500):
        c = r.choice(centres)
        rows.append((r.choice([None, 50 * (k % 30), k, k, k]), [x + r.gauss(0, 0.3) for x in c], r.randrange(4)))
    rows += [(1000 + k, rows[3][1], k % 2) for k in range(120)]  # copies
    rows += [(50 * k, [1.0, float(k)], k % 3) for k in range(12)] + [(100, [], 1), (101, [], 1), (102, [], 2), (150, [0.0] * 5, 2)]
    rows += [(200, None, 1), (250, [1.0] * 5, None), (300, [1.0, None, 0.0, 0.0, 0.0], 1), (350, [math.nan] * 5, 1), (400, [math.inf] * 5, 1)]
    assert same(spark, monkeypatch, rows, parts=1)


def test_scores_of_any_size_are_exact(spark, monkeypatch):
    rows = [(50 * k, [3e38 if k == 0 else 9e6 + k, -5e6 * (k % 2), 7e5 + 1 / 256 * k], k % 2) for k in range(24)]
    assert same(spark, monkeypatch, rows, parts=1)
    assert N.scores(np.array([[2**31 - 1]]), np.array([[2**31 - 1]]))[0, 0] == (2**31 - 1) ** 2


def test_empty_table_and_no_anchor(spark, monkeypatch):
    assert same(spark, monkeypatch, [(7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1)]) == []
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(N, "table", lambda *_: table)
    assert N.op12(spark, "").collect() == []


def test_far_segments_are_not_met(spark):
    """Clusters apart: a search meets the segments of its own cluster only."""
    r = random.Random(4)
    centres = np.eye(8) * 50
    rows = [(k, k % 2, k % 50 == 0, [int(256 * (x + r.gauss(0, 0.1))) for x in centres[k % 8]]) for k in range(4000)]
    index = N.Index(spark.createDataFrame(rows, "id long, label long, anchor boolean, v array<int>"))
    queries = index.anchors.selectExpr("row", "0L as of", f"{N.LEAST}L + 1 as low", f"{N.MOST}L as high")
    every = index.segments.count() * index.chunks.count()
    assert index._met(queries, False).count() == every
    assert index._met(queries, True).count() < every / 20
    near = queries.selectExpr("row", "of", "cast(256 * 256 * 49 * 49 as long) as low", "high")
    assert 0 < index._met(near, False).count() < every / 4
