"""Five stages over `documents`: language ID, SimHash near-dedup, benchmark decontamination, secret masking, packing.

A stage takes (spark, docs, sf_dir) and returns documents with the same columns; the last returns the pieces
of packed sequences. Between stages the documents are a Parquet table, so each stage reads what its
predecessor kept and a lost executor costs a stage's tasks, not the pipeline.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm import decontaminate, langid, neardup, packing, secrets
from bookflow.llm.common import materialize, table

#: Below this pooled probability a text is in none of the learned languages.
LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; texts without letters or in no such language go."""
    return langid.keep(docs, langid.train(docs), LEAST_LANGUAGE)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are 0.8 alike or more, found by wide SimHash prints."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return secrets.redact(docs, public_tokenizers.path("word_bpe_49k.json"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences along the curve: a row per piece."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("simhash_dedup", dedup),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("packing", pack),
]

#: Hashing, a trained network and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
