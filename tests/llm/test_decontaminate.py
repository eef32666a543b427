import random

import numpy as np

from bookflow.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id string, score int", "item_id long, text string, doc_id string"


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h)) / (2 * max(1, len(b)))


def brute(docs, items):
    out = {}
    for i, t in docs:
        for k, b in items:
            if t and b and k is not None and len(D.words(b)) >= 3 and (s := smith_waterman(D.words(t), D.words(b))) >= 0.5:
                out[i, k] = max(s, out.get((i, k), 0))
    return out


def words(r, n, size=400):
    return [f"w{int(size * r.random() ** 2)}" for _ in range(n)]


def cases():
    r = random.Random(8)
    items = [(k, " ".join(words(r, r.randrange(15, 45)))) for k in range(30)] + [(30, "two words"), (31, None), (32, ""), (3, "a repeated item with other words in it"), (40, "Ünïcode, PUNCT! (and) case-split x")]
    docs = [(0, None), (1, ""), (2, "two words"), (3, "ünïcode punct and case split x")]
    for i in range(4, 90):
        w = words(r, r.randrange(5, 200))
        for k in r.sample(range(30), r.choice([0, 0, 1, 2])):
            part = items[k][1].split()
            for _ in range(r.choice([0, 0, 1, len(part) // 6])):
                at = r.randrange(len(part))
                part[at : at + 1] = r.choice([[], ["zz"], [part[at], "yy"]])
            at = r.randrange(len(w))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    return docs, items


def test_alignment_equals_the_table_form():
    r = random.Random(1)
    pairs = [(np.array([r.randrange(6) for _ in range(r.randrange(0, 40))]), np.array([r.randrange(1, 6) for _ in range(r.randrange(1, 20))])) for _ in range(200)]
    assert [s for s, _ in D.align(pairs)] == [smith_waterman(a, b) for a, b in pairs]


def test_finds_what_aligning_every_pair_finds(spark):
    """With every n-gram a seed: each pair that brute force finds and that shares an n-gram. As set: all unedited copies, nearly all edited ones."""
    docs, items = cases()
    a, b = spark.createDataFrame([(i, t, "", 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)
    want = brute(docs, items)
    assert len(want) > 60
    text, item = dict(docs), {k: t for k, t in items if k != 3}
    grams = lambda t: {tuple(w[i : i + 3]) for w in [D.words(t)] for i in range(len(w) - 2)}
    shared = {p: s for p, s in want.items() if p[1] == 3 or grams(text[p[0]]) & grams(item[p[1]])}
    for block in (1 << 22, 900):
        got = D.contamination(a, b, window=1, block_bytes=block).collect()
        assert {(x.doc_id, x.item_id): x.score for x in got} == shared
    for x in got:
        assert b" ".join(D.words(text[x.doc_id])[x.start_word : x.end_word]).decode() == x.passage
    few = {(x.doc_id, x.item_id): x.score for x in D.contamination(a, b).collect()}
    assert few.items() <= want.items()
    assert {p for p, s in want.items() if s == 1} <= few.keys()
    assert len(few) >= 0.95 * len(want)


def test_a_common_item_still_has_seeds(spark):
    item = " ".join(f"c{k}" for k in range(20))
    docs = spark.createDataFrame([(k, f"x{k} {item} y{k}") for k in range(500)], "doc_id long, text string")
    assert D.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).where("score = 1 and start_word = 1 and end_word = 21").count() == 500


def test_copies_with_every_fourth_or_fifth_word_replaced(spark):
    """Each such copy keeps an n-gram in a window whose others occur nowhere; none may be lost."""
    r = random.Random(4)
    items = [(k, " ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(24, 60)))) for k in range(40)]
    for every in (4, 5):
        docs = []
        for k, t in items:
            w, first = t.split(), k % every
            w[first::every] = [f"new{k}x{j}" for j in range(len(w[first::every]))]
            docs.append((k, " ".join(["before"] * 9 + w + ["after"] * 9)))
        want = {p: s for p, s in brute(docs, items).items()}
        assert {(k, k) for k, _ in items} <= want.keys()
        got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(x.doc_id, x.item_id): x.score for x in got} == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d", "", 1)], DOCS), spark.createDataFrame([(1, "a b c d", "")], ITEMS)
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.contamination(docs, items.limit(0)).count() == 0
    assert D.contamination(docs, items).count() == 1


def test_repeats_cost_their_sum(spark):
    """A seed that repeats in item and text: passages equal those of every pair of repeats, and long ones end in time."""
    r = random.Random(6)
    items = D.Items([(k, " ".join(r.choice("abc") for _ in range(r.randrange(3, 30)))) for k in range(8)] + [(8, "a " * 40)], 3)
    seeds = items.seeds(np.ones(items.keys.size, np.int64), 3)
    texts = [" ".join(r.choice("abcx" if r.random() < 0.9 else "yz") for _ in range(r.randrange(0, 150))) for _ in range(40)] + ["a " * 300]
    seq, starts, split = items.encode(texts)
    keys, of, item, low, high = D._places(items, seeds)
    doc, key, head, tail = D._runs(items, starts, *items.hits(seq, keys))
    ends = np.searchsorted(of, np.arange(keys.size + 1))
    rows = []
    for d, k, a, z in zip(doc.tolist(), key.tolist(), head.tolist(), tail.tolist()):
        for at in range(ends[k], ends[k + 1]):
            n = len(items.seqs[item[at]])
            rows.append((d, int(item[at]), max(0, a - int(high[at]) - 3 - n // 2), min(len(split[d]), z - int(low[at]) + n + 3 + n // 2)))
    got = {(d, i, p) for d, i, lo, hi in D._merged(*np.array(rows).T).tolist() for p in range(lo, hi)}
    want = set()
    chosen = {}
    for c in seeds.tolist():
        chosen.setdefault(int(items.keys[items.at[c]]), []).append((int(items.item[c]), int(items.place[c])))
    for d, words_ in enumerate(split):
        own = items.grams(seq[starts[d] : starts[d] + len(words_)])
        for p, g in enumerate(own.tolist()):
            for i, q in chosen.get(g, []):
                n = len(items.seqs[i])
                want |= {(d, i, x) for x in range(max(0, p - q - 3 - n // 2), min(len(words_), p - q + n + 3 + n // 2))}
    assert got == want
    docs = spark.createDataFrame([(1, "ha " * 100_000), (2, "ho ha " * 20)], "doc_id long, text string")
    rows = D.contamination(docs, spark.createDataFrame([(1, "ha " * 2_000)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.score) for x in rows] == [(1, 1.0)]


def test_items_without_an_id_are_compared(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps over it y", "", 1), (2, "nothing of this kind is here", "", 1), (None, "some other passage of five words or six", "", 1)], DOCS)
    items = spark.createDataFrame([(None, "the quick brown fox jumps over it", ""), (None, "other passage of five words", ""), (5, "not in any document at all", "")], ITEMS)
    for block in (1 << 22, 20):
        got = D.contamination(docs, items, block_bytes=block).collect()
        assert {(x.doc_id, x.item_id, x.score) for x in got} == {(1, None, 1.0), (None, None, 1.0)}
    assert [r.doc_id for r in D.drop_contaminated(docs, items).collect()] == [2]


def test_hashed_keys_give_the_same(spark, monkeypatch):
    docs, items = cases()
    a, b = spark.createDataFrame([(i, t, "", 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)
    exact = D.contamination(a, b).collect()
    monkeypatch.setattr(D, "EXACT_KEYS", 1)
    assert sorted(D.contamination(a, b).collect()) == sorted(exact)


def test_query_equals_aligning_every_pair(spark, monkeypatch):
    docs, items = cases()
    frames = {"documents": spark.createDataFrame([(i, t, "", 1) for i, t in docs], DOCS), "benchmark": spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)}
    monkeypatch.setattr(D, "table", lambda spark, sf_dir, name: frames[name])
    got = {(x.doc_id, x.item_id): x.score for x in D.op9(spark, "").collect()}
    want = brute(docs, items)
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want)
