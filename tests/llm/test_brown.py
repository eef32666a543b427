import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bookflow.llm import brown as B


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def base(docs):
    """The contract's unigram by plain counting: {doc_id: (held_out, n_tokens, n_known, N, base)}."""
    fold = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, t in docs if not fold[i] for w in [*split(t), "\n"])
    n, v = sum(c.values()), len(c)
    return {i: (fold[i], len(split(t)) + 1, sum(c[w] > 0 for w in [*split(t), "\n"]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*split(t), "\n"])) for i, t in docs}


def likelihood(counts, cls):
    k = cls.max() + 1
    one = np.eye(k)[cls]
    n = one.T @ counts @ one
    f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def test_exchange_ends_where_no_move_gains():
    rng = np.random.default_rng(3)
    w = rng.poisson(2.0, (15, 15)).astype(float)
    w[:7, 7:14] += rng.poisson(9.0, (7, 7))
    cls = B.exchange(w, 4, sweeps=50)
    best = likelihood(w, cls)
    assert cls[-1] == 3 and (cls[:-1] < 3).all()
    start = np.append(np.argsort(np.argsort(-(w.sum(0) + w.sum(1))[:-1], kind="stable")) % 3, 3)
    assert best > likelihood(w, start)
    for i in range(14):
        for b in range(3):
            other = cls.copy()
            other[i] = b
            if len(set(other)) == 4:
                assert likelihood(w, other) <= best + 1e-6


def test_query_on_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in B.op7(spark, sf).collect()}
    for i, want in base(docs).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def rows():
    texts = ["the cat sat on the mat", "the dog sat on the cat", None, "", "Der Hund und die Katze", "der hund DER HUND", "x" * 3000, "é É a\u0085b", "the end"]
    return [(k, texts[k % len(texts)], "z") for k in range(60)] + [(3, "the cat", "z")] * 3


@pytest.mark.parametrize("head", [2, 1000])
def test_small_heads_join_the_rest(spark, head):
    docs = [(i, t) for i, t, _ in rows()]
    frame = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string")
    got = B.perplexity(frame, frame, head=head, top=5, suffixes=4, classes=4).collect()
    c = Counter(w for _, t in docs for w in [*split(t), "\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(split(t)) + 1, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*split(t), "\n"]), 6)) for i, t in docs)
    assert sorted((r.doc_id, r.n_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.n_known == r.n_tokens for r in got)


def test_next_word_probabilities_sum_to_one(spark):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string")
    counts = B.word_counts(frame)
    model = B.learn(frame, counts, head=1000, top=5, suffixes=4, classes=4)
    every = {bytes(r.word): r.n for r in counts.collect()}
    cls = {w: int(model.cls[model.encode([w])[1][0]]) for w in every}
    for before in range(model.step.shape[0]):
        total = sum(10 ** (model.step[before, cls[w]] - model.emit[cls[w]]) * (n + 1) for w, n in every.items())
        total += 10 ** model.step[before, model.cls[model.end]]
        total += sum(10 ** (model.step[before, k] - model.emit[k]) for k in range(model.step.shape[0]) if k != model.cls[model.end])
        assert total == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = B.perplexity(docs, docs.limit(0)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(0, 1, 0, 0, 0.0), (1, 3, 0, 0, 0.0)]
    assert B.perplexity(docs.limit(0), docs).count() == 0


def test_score_by_hand(spark, sf):
    """Each text's score from the model's classes and plain counts, token by token."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    train = docs.where(~B.held_out("doc_id"))
    counts = B.word_counts(train)
    model = B.learn(train, counts, head=800)
    got = {r.doc_id: r for r in B.perplexity(docs, train, head=800).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    learned = [split(t) for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in learned for w in t)
    cls = lambda w: int(model.cls[model.end if w == "\n" else model.encode([w.encode()])[1][0]])
    of = {w: cls(w) for w in {w for _, t in texts for w in split(t)} | {"\n"}}
    k, n = len(model.step), Counter()
    for t in learned:
        n.update(zip([of["\n"], *(of[w] for w in t)], [*(of[w] for w in t), of["\n"]]))
    tokens, kinds = Counter(), Counter()
    for w, m in [*c.items(), ("\n", len(learned))]:
        tokens[of[w]] += m
        kinds[of[w]] += w != "\n"
    every = sum(tokens[x] + 1 for x in range(k))
    after = Counter()
    for (a, _), m in n.items():
        after[a] += m
    for i, t in texts[:60]:
        want, a = 0.0, of["\n"]
        for w in [*split(t), "\n"]:
            b = of[w]
            want += math.log10((n[a, b] + 2 * (tokens[b] + 1) / every) / (after[a] + 2)) + math.log10((c[w] if w != "\n" else len(learned)) + 1) - math.log10(tokens[b] + kinds[b] + 1)
            a = b
        assert got[i].score == pytest.approx(want, rel=1e-9), i


def test_sweeps_raise_the_likelihood(spark, sf):
    train = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = B.word_counts(train)
    reached = []
    for sweeps in (1, 6):
        seen = []
        model = B.learn(train, counts, head=2000, top=100, suffixes=50, classes=16, sweeps=sweeps, seen=seen)
        n = np.zeros_like(model.step)
        for r in train.collect():
            seq = model.cls[model.sequence([r.text])]
            np.add.at(n, (seq[:-1], seq[1:]), 1)
        f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
        reached.append(f(n) - f(n.sum(0)) - f(n.sum(1)))
        assert seen == sorted(seen) and seen[-1] == pytest.approx(reached[-1], rel=1e-12) and len(seen) == sweeps
        assert len(set(model.cls[:-1].tolist())) > 8 and (model.cls[:-1] < 15).all() and model.cls[-1] == 15
    assert reached[1] > reached[0]
