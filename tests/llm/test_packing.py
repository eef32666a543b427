import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from bookflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_curve_visits_every_cell_once_by_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.arange(1 << bits)
        cells = np.stack(np.meshgrid(*[side] * d, indexing="ij"), -1).reshape(-1, d)
        key = packing.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_encoder_equals_the_library():
    r = random.Random(2)
    hard = ["", " ", "\n\n  x", "a\x85b\xa0c\x1cd", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|", "Ünïcödé ǅ ɏ", "日本語 テスト", "٣٤ ½²", "ab" * 300, " " * 300, "don't  we'LL"]
    made = ["".join(r.choices(["a", "The", " ", "  ", "\n", "7", "é", "ß", "$$", "'s", "\t", "ing", "\xad", "ÿ", "ŉ", "\x00", "<|endoftext|>"], k=r.randrange(90))) for _ in range(500)]
    lib, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for t in hard + made:
        assert own(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def holds(pieces, docs):
    """Every id lies in one piece, sequences are gapless, at most one short sequence a task."""
    lib = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(lib.encode(t or "", add_special_tokens=False).ids + [0])
    by, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    assert by.keys() == want.keys()
    for i, own in by.items():
        assert len(want[i]) > 1 or [p.start for p in sorted(own, key=lambda p: p.start)] == list(np.cumsum([0] + [p.length for p in sorted(own, key=lambda p: p.start)])[:-1])
        assert sum(p.length for p in own) == sum(map(len, want[i]))
        for p in own:
            assert any(p.doc_tokens == len(w) and p.ids_crc32 == zlib.crc32(np.array(w[p.start : p.start + p.length], "<u4").tobytes()) for w in want[i])
    short = 0
    for own in seqs.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        total = sum(p.length for p in own)
        assert total <= 1024
        short += total < 1024
    assert short <= len({s >> 32 for s in seqs})


def test_query_on_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    holds(packing.op1(spark, sf).collect(), docs)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 9000, None), (3, "a" * 9000, None), (None, "n", "y")] + [(k, "same text here", "") for k in range(4, 400)]
    monkeypatch.setattr(packing, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    holds(packing.op1(spark, "").collect(), [(i, t) for i, t, _ in rows])
    monkeypatch.setattr(packing, "table", lambda *_: spark.createDataFrame([], "doc_id long, text string"))
    assert packing.op1(spark, "").count() == 0


def test_neighbours_are_alike(spark, sf):
    """Along the curve, the language changes less often than in table order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    key = packing.document_keys([(t or "").encode() for t in docs.text], packing.projection())
    changes = lambda x: (x.values[1:] != x.values[:-1]).sum()
    assert changes(docs.lang.iloc[np.argsort(key, kind="stable")]) < 0.6 * changes(docs.lang)
