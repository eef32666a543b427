import random

import numpy as np
import xxhash

from bookflow.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, a long"


def brute(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w, cur = [], ""
    for c in low:
        if c in " \t\n\r\x0b\x0c":
            w, cur = w + [cur] * bool(cur), ""
        else:
            cur += c
    w += [cur] * bool(cur)
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{doc_id: component} by comparing every pair."""
    up = {i: i for i in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for t in [None, "", " \n\t", "One", "Two WORDS", "Ünï Ä b c", "a\x0bb\x0cc\rd e", "x " * 9, "a b c\u0085d e"]:
        assert simhash.fingerprint(t) == brute(t)


def test_hash_equals_sparks_own(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def test_groups_equal_all_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefg", k=4)) for _ in range(300)]
    docs = [(0, None), (1, ""), (2, "Solo"), (3, "solo"), (4, "two words")]
    base = [r.choices(words, k=60 + 30 * k) for k in range(12)]
    for i in range(5, 240):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "en", "x", 1) for i, t in docs], SCHEMA)).collect()
    want = {i: brute(t) for i, t in docs}
    assert {x.doc_id: x.fp % 2**64 for x in got} == want
    assert {x.doc_id: x.component_id for x in got} == brute_components(want)


def test_blocks_of_a_hot_posting_find_every_link(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {}
    while len(fps) < 150:
        fps.setdefault(base ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 5, 9]))), len(fps))
    rows = [(f - 2**64 if f >= 2**63 else f, i) for f, i in fps.items()]
    from bookflow.llm.graph import components

    found = components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"), block=16)).collect()
    want = {i: c for i, c in brute_components({i: f for f, i in fps.items()}).items()}
    assert {x.node: x.component for x in found} == {i: c for i, c in want.items() if sum(v == c for v in want.values()) > 1}


def test_empty_repeated_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b c d", None, None, None), (7, "a b c d", None, None, None), (None, "a b c d", None, None, None), (None, "z", None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id is None, x.component_id or -1) for x in got) == [(False, 7), (False, 7), (True, -1), (True, 7)]


def test_count_filter_forms_few_pairs_and_loses_none():
    """In one posting: pairs formed are far fewer than all, and all within three bits are among them."""
    r = np.random.default_rng(6)
    n, slot = 600, 2
    fp = r.integers(0, 2**63, n).astype(np.int64)
    fp[300:] = fp[r.integers(0, 300, 300)] ^ (np.int64(1) << r.integers(0, 63, 300)) ^ (np.int64(1) << r.integers(0, 63, 300))
    byte = fp.view(np.uint8).reshape(-1, 8)
    byte[:, list(simhash.TRIPLES[slot])] = 7  # what a posting shares
    i, j = simhash.candidates(np.zeros(n, np.int64), np.full(n, slot), fp)
    shared = (byte[:, None] == byte[None, :]).sum(2)
    want = {(a, b) for a, b in np.argwhere(shared >= 5).tolist() if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    every = n * (n - 1) // 2
    close = {(a, b) for a in range(n) for b in range(a + 1, n) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 3}
    print(f"{every} pairs, {len(i)} after the count filter, {len(close)} within three bits")
    assert close <= want and len(i) < every / 50
