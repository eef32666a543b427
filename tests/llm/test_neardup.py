import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookflow.llm import neardup as N


def sets(t, words=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
    w = [x for x in w if x]
    return frozenset([" ".join(w)] if 0 < len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)])


def brute(texts, least=0.8):
    """{row: least row of its group} by comparing every pair, and the least similarity of a link between groups' rows."""
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    s = {i: sets(t) for i, t in texts.items()}
    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(s[i] & s[j])
            if s[i] == s[j] or (both and both >= least * len(s[i] | s[j])):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def corpus(seed, n=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefg", k=4))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(60 + 40 * k)] for k in range(10)]
    texts = [None, "", " ", "Solo", "solo", "two words", "two words"]
    while len(texts) < n:
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w) if r.random() < 0.8 else " ".join([*(word() for _ in range(30)), *passage]))
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [256, 8])
def test_groups_equal_all_pairs(spark, block):
    texts = corpus(1)
    frame = spark.createDataFrame(list(texts.items()), "row long, text string")
    got = {r.row: r.comp for r in N.groups(frame, block=block).collect()}
    assert got == brute(texts)


def test_prints_agree_as_the_angle_says():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[100:], r.integers(0, 2**63, 100).astype(np.uint64)]))
    x, y = (np.frombuffer(N.wide_print(s), np.uint8) for s in (a, b))  # similarity 0.8
    assert abs(np.unpackbits(x ^ y).mean() - np.arccos(800 / 900) / np.pi) < 0.04
    assert (x == y).sum() >= N.MIN_SHARED


def test_rows_to_keep(spark):
    words = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(9, words), (4, words + " x"), (4, words + " x"), (None, words), (7, other), (None, "alone in here"), (None, "alone in here"), (8, None), (6, ""), (5, "lone")]
    frame = spark.createDataFrame([(i, t, k, k, k, k, "a.b") for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp int, _id int, _rows int, row int, `a.b` string")
    got = N.keep_one(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "alone in here"), (4, words + " x"), (5, "lone"), (6, ""), (7, other)]
    assert N.keep_one(frame.limit(0)).count() == 0


def test_copies_planted_in_documents(spark, sf):
    """Recall on real texts: every pair of whole texts at 0.8 or more."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row"), "text")
    texts = {r.row: r.text for r in docs.collect()}
    got = {r.row: r.comp for r in N.groups(docs).collect()}
    assert got == brute({i: (t or "").replace("\n", " ").replace("\t", " ") for i, t in texts.items()})


def test_a_very_long_text(spark):
    words = [f"w{k}" for k in range(120_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[5:])), (2, "short one")]
    got = {r.row: r.comp for r in N.groups(spark.createDataFrame(rows, "row long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_blocks_bring_all_components_of_a_posting_together(spark):
    """Large and small components, none in the way of another: each pair across components shares a pair of blocks."""
    comps = {0: 40, 1: 13, 2: 3, 3: 1, 4: 1}
    reps, at = {}, 0
    for c, m in comps.items():
        for _ in range(m):
            reps[at], at = c, at + 1
    met = spark.createDataFrame([(7, r) for r in reps] + [(8, r) for r in range(40)] + [(9, r) for r in (0, 40, 53)], "posting long, rep long")
    comp = spark.createDataFrame([(r, c, 0) for r, c in reps.items()], "rep long, comp long, cell long")
    held = {}
    for x in N._blocks(met, comp, 8).collect():
        held[x.posting, x.rep] = {tuple(sorted((tuple(x.own), tuple(o)))) for o in x.all if o.part == N.ALONE or o.part != x.own.part}
    assert {p for p, _ in held} == {7, 9}  # posting 8 holds one component
    for p in (7, 9):
        own = [r for q, r in held if q == p]
        assert len(own) == (len(reps) if p == 7 else 3)
        assert all(held[p, a] & held[p, b] for a in own for b in own if reps[a] != reps[b])


def test_stars_meet_every_text_of_a_first_one(spark):
    """Lists of any length give the pairs of the plain join: sizes alike, positional bytes and bits within the bounds, once each."""
    r = np.random.default_rng(5)
    base = r.integers(0, 256, N.PRINTS * 8, dtype=np.uint8)
    prints = {}
    for k in range(60):
        x = base.copy()
        x[r.choice(x.size, int(r.integers(0, 180)), replace=False)] ^= 1
        prints[k] = x
    sizes = {k: int(r.integers(80, 130)) for k in prints}
    rows = [(p, n, rep, lead) for p, lead, n in ((1, 0, 60), (2, 0, 60), (3, 5, 20), (4, 7, 2)) for rep in range(lead, lead + n) if rep in prints]
    met = spark.createDataFrame(rows, "posting long, n long, rep long, lead long")
    heads = spark.createDataFrame([(k, sizes[k], bytes(prints[k])) for k in prints], "rep long, size int, print binary")
    want = set()
    for _, _, b, a in rows:
        shared = int((prints[a] == prints[b]).sum())
        alike = min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])
        if a != b and alike and shared >= N.MIN_SHARED and np.unpackbits(prints[a] ^ prints[b]).sum() <= N.MAX_BITS:
            want.add((a, b, shared))
    for block in (256, 8):
        assert sorted(map(tuple, N._stars(met, heads, 0.8, block).collect())) == sorted(want)
    assert 10 < len(want) < 80


@pytest.mark.parametrize("batch", [1, 5, 16, 1000])
def test_postings_become_lists_however_they_are_batched(batch):
    """Each posting of two texts or more in lists of bounded length under its least text; texts alone go."""
    r = np.random.default_rng(batch)
    of = {p: np.sort(r.choice(1000, n, replace=False)) for p, n in enumerate([1, 2, 1, 1, 8, 9, 16, 17, 3, 1, 40, 1])}
    rows = [(p, int(k)) for p, own in of.items() for k in own]
    batches = [pa.RecordBatch.from_pylist([{"posting": p, "rep": k} for p, k in rows[a : a + batch]], pa.schema([("posting", pa.int64()), ("rep", pa.int64())])) for a in range(0, len(rows), batch)]
    got = [x for b in N._listed(8)(iter(batches)) for x in b.to_pylist()]
    held = {}
    for x in got:
        own = held.setdefault(x["posting"], [])
        assert 0 < len(x["reps"]) <= 8 and x["lead"] == of[x["posting"]][0]
        own += x["reps"]
        assert x["n"] == len(own)
    assert held == {p: own.tolist() for p, own in of.items() if len(own) > 1}
    assert not list(N._listed(8)(iter([])))


def test_rows_that_meet_by_posting_are_blocks_not_texts(spark):
    """A group of near copies whose postings hold a stranger each: what meets by posting is a row a block, what meets a fingerprint a row a text."""
    texts, postings, block = 300, 24, 64
    met = spark.createDataFrame([(p, r) for p in range(postings) for r in [*range(texts), texts + p]], "posting long, rep long")
    comp = spark.createDataFrame([(r, 0 if r < texts else r, 0) for r in range(texts + postings)], "rep long, comp long, cell long")
    heads = spark.createDataFrame([(r, 100, bytes(N.PRINTS * 8)) for r in range(texts + postings)], "rep long, size int, print binary")
    held = N._blocks(met, comp, block)
    found = N._meet(held, heads, comp)
    # a stranger's block meets itself and each of the group's blocks
    assert found.count() == postings * (texts + 1 + -(-texts // block))
    made = {}

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if "Join" in name:
            made[node.simpleString(200)] = node.metrics().apply("numOutputRows").value()
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    found.collect()
    walk(found._jdf.queryExecution().executedPlan())
    assert made and max(made.values()) <= texts + postings


def pages_made(spark, seed, texts=120, postings=200, size=300):
    """Postings of a group of texts, on pages: (page, posting, reps) and the postings, components and fingerprints."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 256, (4, N.PRINTS * 8), dtype=np.uint8)
    prints, sizes, comps = {}, {}, {}
    for k in range(texts):
        x = base[k % 4].copy()
        x[r.choice(x.size, int(r.integers(0, 180)), replace=False)] ^= 1
        prints[k], sizes[k], comps[k] = bytes(x), int(r.integers(80, 130)), k % 7 if k % 3 else k
    of = {p: np.sort(r.choice(texts, int(r.integers(3, 30)), replace=False)).tolist() for p in range(postings)}
    lists = [(p, len(own[: k + 8]), own[0], own[k : k + 8]) for p, own in of.items() for k in range(0, len(own), 8)]
    met = spark.createDataFrame(lists, "posting long, n long, lead long, reps array<long>")
    comp = spark.createDataFrame([(k, comps[k], k % 4, k % 9) for k in prints], "rep long, comp long, home long, cell long")
    heads = spark.createDataFrame([(k, sizes[k], prints[k]) for k in prints], "rep long, size int, print binary")
    return N._pages(met, comp, size), of, prints, sizes, comps, heads, comp


def test_pages_hold_each_posting_whole_and_are_bounded(spark):
    size = 300
    pages, of, *_ = pages_made(spark, 1, size=size)
    on, members = {}, {}
    for x in pages.collect():
        on.setdefault(x.posting, set()).add(x.page)
        members.setdefault(x.posting, []).extend(x.reps)
    assert {p: sorted(m) for p, m in members.items()} == of
    assert all(len(x) == 1 for x in on.values())
    many = {}
    for p, (page,) in on.items():
        many[page] = many.get(page, 0) + len(of[p])
    assert len(many) > 5 and max(many.values()) < 3 * size


@pytest.mark.parametrize("size", [40, 10_000])
def test_pages_give_the_pairs_of_their_postings(spark, size):
    """Every pair across components in a posting that is within the bounds, and no other, under its two cells."""
    pages, of, prints, sizes, comps, heads, comp = pages_made(spark, 2, size=size)
    want = set()
    for own in of.values():
        for x, a in enumerate(own):
            for b in own[x + 1 :]:
                p, q = (np.frombuffer(prints[k], np.uint8) for k in (a, b))
                near = min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])
                if comps[a] != comps[b] and near and (p == q).sum() >= N.MIN_SHARED and np.unpackbits(p ^ q).sum() <= N.MAX_BITS:
                    want.add((a, b))
    got = set()
    for x in N._paged(N.materialize(pages), heads, comp).collect():
        assert x.ca <= x.cb and set(x.need) == set(x.a) | set(x.b)
        assert {k % 9 for k in x.a} == {x.ca} and {k % 9 for k in x.b} == {x.cb}
        got |= {tuple(sorted(k)) for k in zip(x.a, x.b)}
    assert got == want and len(want) > 50


def generated(df):
    """Rows that each explode of a frame makes, by what it unrolls, as it is computed."""
    df.collect()
    made = {}

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Generate":
            made[node.simpleString(60)] = node.metrics().apply("numOutputRows").value()
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return made


def test_a_group_of_texts_is_unrolled_once_a_page_not_once_a_posting(spark):
    """A group of texts that meet in many postings: rows are texts for each page and first text, not for each posting."""
    texts, postings = 90, 60
    met = spark.createDataFrame([(p, texts, 0, list(range(texts))) for p in range(postings)], "posting long, n long, lead long, reps array<long>")
    comp = spark.createDataFrame([(k, k, 0, 0) for k in range(texts)], "rep long, comp long, home long, cell long")
    heads = spark.createDataFrame([(k, 100, bytes(N.PRINTS * 8)) for k in range(texts)], "rep long, size int, print binary")
    pages = N.materialize(N._pages(met, comp, 16_384))
    made = generated(N._paged(pages, heads, comp))
    assert made and max(made.values()) == texts  # 5,400 texts of postings
    made = generated(N._stars(N._met_once(met, 256), heads, 0.8, 256))
    assert made and max(made.values()) == texts


@pytest.mark.parametrize("block", [2, 3])
def test_long_and_short_postings_give_all_pairs(spark, block):
    """Blocks so small that there are postings beyond a page: both ways together give the groups of all pairs."""
    texts = corpus(7, 200)
    frame = spark.createDataFrame(list(texts.items()), "row long, text string")
    assert {r.row: r.comp for r in N.groups(frame, block=block).collect()} == brute(texts)
