import zlib

import numpy as np

from bookflow.llm import langid as L


def slow(net, text):
    """Byte by byte, as the docstring has it."""
    raw, total = text.encode(), np.zeros(len(net.langs))
    sig = lambda v: np.clip(0.2 * v + 0.5, 0, 1)

    def walk(d, xs):
        h, n = np.zeros(d.h), d.h
        for b in xs:
            a, u = d.e[:, b], d.u @ h
            z, r = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * u[2 * n :])
            h = (1 - z) * c + z * h
            yield h

    for at in range(0, len(raw), L.WINDOW):
        part = raw[at : at + L.WINDOW].ljust(L.WINDOW, b"\0")
        f, r = list(walk(net.ahead, part)), list(walk(net.behind, part[::-1]))[::-1]
        for t in range(min(L.WINDOW, len(raw) - at)):
            z = net.w @ np.concatenate([f[t], r[t]]) + net.b[:, 0]
            total += np.exp(z) / np.exp(z).sum()
    return total / len(raw)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b", "c"], hidden=3)
    for name in ("ahead", "behind"):
        d = getattr(net, name)
        d.e, d.u = d.e.astype(float), d.u.astype(float)
    net.w, net.b = net.w.astype(float), net.b.astype(float)
    x, y = rng.integers(0, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    mask = rng.random((7, 5)) < 0.8
    _, grads = net.loss(x, mask, y)
    for w, g in zip(net.weights, grads):
        spots = [tuple(i) for i in np.argwhere(np.abs(g) > np.abs(g).max() / 3)[:4]]
        for s in spots:
            keep, eps = w[s], 1e-2
            w[s] = keep + eps
            up = net.loss(x, mask, y)[0]
            w[s] = keep - eps
            down = net.loss(x, mask, y)[0]
            w[s] = keep
            assert abs((up - down) / (2 * eps) - g[s]) < 2e-3 + 0.05 * abs(g[s])


def test_pooling_covers_whole_texts():
    net = L.Network(["a", "b"])
    texts = ["x", "Ünï cödé " * 30, "y" * 64, "z" * 65, "w " * 200]
    assert np.allclose(net.pooled([t.encode() for t in texts], group=3), [slow(net, t) for t in texts], atol=1e-4)


def test_query_learns_on_its_folds_only(spark, sf, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    poisoned = [(i, t, "xx" if fold[i] else lang, "en") for i, t, lang in rows] + [(-1, None, "en", ""), (-2, "", "en", ""), (-3, "12 $$ 34", "de", ""), (None, "the and of the in the", None, "")]
    monkeypatch.setattr(L, "table", lambda *_: spark.createDataFrame(poisoned, "doc_id long, text string, lang string, lang_pred string"))
    got = {r.doc_id: r for r in L.op4(spark, "").collect()}
    truth = {i: lang for i, _, lang in rows}
    assert len(got) == len(poisoned)
    assert {r.lang_pred for r in got.values()} <= {*truth.values(), "und"}
    assert [got[k].lang_pred for k in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0
    held = [i for i in fold if fold[i]]
    assert all(got[i].held_out == fold[i] for i in fold)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (None, "more", "en")], "doc_id long, text string, lang string")
    net = L.train(docs)
    assert {r.lang_pred for r in L.identify(docs, net).collect()} == {"und"}
    assert L.identify(docs.limit(0), net).count() == 0
