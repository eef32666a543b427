import re
import zlib
from collections import Counter

import numpy as np

from bookflow.llm import toxicity as T


def grams(text):
    whole = " " + re.sub(r"\s+", " ", (text or "").lower()).strip(" ") + " "
    return Counter(whole[a : a + n] for n in T.SIZES for a in range(len(whole) - n + 1))


def slow_bucket(gram):
    h = 0
    for n, c in enumerate(gram, 1):
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + n) % 2**64
    return (h * 0x9E3779B97F4A7C15 % 2**64) >> 46


def slow(text):
    count = Counter()
    for g, n in grams(text).items():
        count[slow_bucket(g)] += n
    return sorted(b * 3 + k for b, n in count.items() for k, level in enumerate(T.LEVELS) if n >= level)


def test_features_are_those_of_all_grams(monkeypatch):
    texts = [None, "", "  ", "a", "Ab  c\n\td", "ÀÉÎ ß 👩‍👩 x", "word " * 700 + "end", "many different words " * 4000]
    want = [slow(t) for t in texts]
    assert [sorted(T.features(t).tolist()) for t in texts] == want
    monkeypatch.setattr(T, "STRETCH", 997)  # long texts in overlapping stretches
    assert sorted(T.features(texts[-1]).tolist()) == want[-1]


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.random((60, 8)) < 0.4
    y = (x[:, 0] | (rng.random(60) < 0.2)).astype(int)
    ratio, importance = rng.normal(size=8), rng.random(60) + 0.5
    w, b = T.fit([np.flatnonzero(r) for r in x], y, importance, ratio, steps=4000)
    w = w / ratio

    def loss(w, b):
        z = x @ (w * ratio) + b
        return (importance / importance.sum()) @ (np.logaddexp(0, z) - y * z) + T.PENALTY / 2 * w @ w

    base = loss(w, b)
    for k in range(8):
        for d in (1e-3, -1e-3):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, b) >= base - 1e-9
    assert min(loss(w, b + 1e-3), loss(w, b - 1e-3)) >= base - 1e-9


def test_held_out_accuracy_and_folds(spark, monkeypatch):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    docs, labels = read("documents").select("doc_id", "text").collect(), {r.doc_id: r.toxic for r in read("labels").collect()}
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    # labels of the held-out fold are turned around: they must not be seen
    poisoned = [(i, 1 - y if fold[i] else y, 0) for i, y in labels.items()] + [(None, 1, 0), (5, None, 0), (6, 7, 0), (10**9, 1, 0)]
    extra = [(-1, None), (-2, ""), (None, "you stupid idiot"), (None, "you stupid idiot")]
    tables = {
        "documents": spark.createDataFrame([(r.doc_id, r.text, 1.0, 1) for r in docs] + [(*x, 0.0, 0) for x in extra], "doc_id long, text string, score double, y int").repartition(8),
        "labels": spark.createDataFrame(poisoned, "doc_id long, toxic int, text int"),
    }
    monkeypatch.setattr(T, "table", lambda s, d, n: tables[n])
    got = T.op11(spark, "").collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].held_out == f for i, f in fold.items()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [i for i in labels if fold[i]]
    hit = [by[i].predicted for i in held if labels[i] == 1]
    false = [by[i].predicted for i in held if labels[i] == 0]
    print("held-out recall", np.mean(hit), "false alarms", np.mean(false), len(hit), len(false))
    # about one toxic document in twenty holds no word of abuse
    assert np.mean(hit) > 0.92 and np.mean(false) < 0.005
    assert [r.predicted for r in got if r.doc_id is None] == [1, 1]
    assert by[-1].predicted == by[-2].predicted == 0 and by[-1].score == by[-2].score


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for rows, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = T.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {round(r.score, 9) for r in T.score(docs, model).collect()} == {want}
    assert T.score(docs.limit(0), T.constant(0.5)).count() == 0


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "vile word" if k % 2 else "kind word") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    want = T.train(docs, labels).weight
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert np.array_equal(T.train(docs, labels).weight, want)
