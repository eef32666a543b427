import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from bookflow.llm import decontaminate, neardup, secrets

from test_decontaminate import smith_waterman
from test_neardup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the and attion to thanedble the anea eriner thanea of that with this from were ".split()
DE = "der die und nicht verheit enlich schung keit eine mit dem den zu einber ungen auß ".split()


def corpus():
    r = np.random.default_rng(1)
    rows = []
    for k in range(150):
        lang, words = ("en", EN) if k % 2 else ("de", DE)
        rows.append((k, " ".join(r.choice(words, 60)), lang, "s"))
    rows += [(200, rows[3][1], "en", "s"), (201, rows[3][1] + " x", "en", "s"), (202, "12 34 $$ !!", "en", "s"), (203, None, "en", "s"), (204, "", None, "s")]
    rows += [(205, rows[5][1] + " password=abcdef0123456789 tail", "en", "s"), (206, rows[8][1] + " pwd: Xk9#qT2!vLm8", None, None), (5, rows[5][1], "en", "s")]
    rows += [(None, rows[3][1], "en", "s"), (None, " ".join(r.choice(EN, 70)), "en", "s")]
    return [(*x, len(x[1] or "")) for x in rows]


def test_each_stage_takes_effect(spark, sf):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    as_rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)

    spoken = P.language(spark, docs, sf)
    assert spoken.columns == docs.columns
    assert as_rows(spoken) == sorted((r for r in rows if r[0] not in (202, 203, 204)), key=str)

    kept = P.dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    top, least = brute({k: r[1] for k, r in enumerate(rows)}), {}
    for k, c in top.items():
        least[c] = min(least.get(c, (True, 0, k)), (rows[k][0] is None, rows[k][0] or 0, k))
    want = [rows[k][:2] for _, _, k in least.values()]
    assert not {200, 201} & {i for i, _ in want} and (None, rows[-1][1]) in want
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = [(i, f"{rows[0][1]} {bench[0][1]} {rows[2][1]}", "en", "s", 1) for i in (300, None)]
    leaked = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in [*rows, *bad]], SCHEMA + ", fp long, _id long, _rows long, row long")
    clean = P.decontamination(spark, leaked, sf)
    assert clean.columns == leaked.columns and as_rows(clean.select(*docs.columns)) == sorted(rows, key=str)

    masked = P.secret_masking(spark, docs, sf)
    text = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == docs.columns and len(masked.collect()) == len(rows)
    assert text[205].text == rows[5][1] + " [SECRET] tail" and text[206].text == rows[8][1] + " pwd: [SECRET]"
    assert text[205].n_chars == len(text[205].text) and text[203].text is None
    assert all(text[i].text == t for i, t, *_ in rows[:150])


def test_masking_of_overlapping_spans():
    words = {}
    assert secrets.redacted("a token=0123456789abcdef0123 b 0123456789abcdef c", words) == "a [SECRET] b [SECRET] c"
    assert secrets.redacted("password=abcdefghijklmn", words) == "[SECRET]"
    assert secrets.redacted("nothing", words) == "nothing"


def test_pipeline_against_brute_force(spark, sf):
    """Every stage after the network's choice, done plainly on its rows."""
    got = P.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: r.text for r in P.language(spark, docs, sf).collect()}
    assert len(left) > 0.95 * docs.count()
    top = brute({i: " ".join((t or "").split()) for i, t in left.items()})
    left = {i: t for i, t in left.items() if top[i] == i}
    bench = [decontaminate.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = [{tuple(b[i : i + 3]) for i in range(len(b) - 2)} for b in bench]

    def leaked(t):
        w = decontaminate.words(t)
        own = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        return any(len(own & g) > 2 and smith_waterman(w, b) >= decontaminate.THRESHOLD for b, g in zip(bench, grams))

    left = {i: t for i, t in left.items() if not leaked(t)}
    words = secrets.dictionary(public_tokenizers.path("word_bpe_49k.json"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: lib.encode(secrets.redacted(t, words), add_special_tokens=False).ids + [0] for i, t in left.items()}
    pieces = defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
    assert pieces.keys() == want.keys()
    for i, own in pieces.items():
        assert sum(p.length for p in own) == len(want[i])
        assert all(p.ids_crc32 == zlib.crc32(np.array(want[i][p.start : p.start + p.length], "<u4").tobytes()) for p in own)


def test_empty(spark, sf):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0
    assert neardup.keep_one(empty).columns == empty.columns
