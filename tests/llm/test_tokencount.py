import random

import public_tokenizers
from tokenizers import Tokenizer

from bookflow.llm import tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", " ", "<|startoftext|>", "a<|endoftext|>b <|endoftext|><|startoftext|>", "<|END|> <|endoftext", "aaaaaaaaaaaaaaaaaaaa", "don't I'LL we'Ve",
    "ΣΑΣ ΌΔΟΣ ς", "İstanbul ǅ ﬁ Å é", "日本語テキスト한국어", "👩‍👩‍👧 🇫🇷", "x\x1cy\x1dz\x85w\xa0v u​t", "123 ４５ ½ ²", "!!!???...", "ab" * 400, "٣٤ हिन्दी ไทย",
]


def library(texts):
    return [len(x) for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library():
    r = random.Random(1)
    made = ["".join(r.choices(["a", "n", "th", "er", "Zz", "é", "ß", "'s", " ", "\n", "7", "$", "<|", "|>", "ing", "ж", "字", "́"], k=r.randrange(1, 80))) for _ in range(600)]
    merger = tokencount.Merger(PATH)
    assert merger.count(HARD + made).tolist() == library(HARD + made)


def test_a_forgetting_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 1)
    merger = tokencount.Merger(PATH)
    for t in HARD:
        assert merger.count([t]).tolist() == library([t])


def test_query_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    got = tokencount.op2(spark, sf).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert got.n_tokens.tolist() == library(docs.text.tolist())
    assert got.n_bytes.tolist() == [len((t or "").encode()) for t in docs.text]
    assert got.over_limit.tolist() == [n > 2048 for n in got.n_tokens]


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, n_tokens string"
    assert tokencount.token_counts(spark.createDataFrame([], schema), PATH).count() == 0
    got = tokencount.token_counts(spark.createDataFrame([(1, "hi", ""), (1, "hi", ""), (None, None, None)], schema), PATH).collect()
    assert sorted((x.doc_id or 0, x.n_bytes, x.n_tokens) for x in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1)]
