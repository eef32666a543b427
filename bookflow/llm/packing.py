"""Packing along a space-filling curve.

Each document becomes a vector of hashed byte-bigram frequencies, projected by a fixed random matrix to
four dimensions; the cell of that point has a position on a Hilbert curve. Spark range-sorts the documents
by (position, doc_id), so neighbours in content are neighbours in order and a crowd at one position is
still split among tasks by doc_id. Each task then reads its stretch of the curve as one stream of tokens,
each document followed by id 0, and cuts it every `length` ids: only a task's last sequence is short.

Rules: null text is empty text (one id, the 0); repeated rows are packed each; a null doc_id sorts first;
other columns are ignored; an empty table gives an empty table; a document of any length is cut as often
as needed. A sequence id is the task's number times 2^32 plus the sequence's number in the task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .tokencount import byte_alphabet

DIMS, BITS, HASHED = 4, 15, 4096


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (n, d) with `bits` bits a side (Skilling, 2004)."""
    x, d = cells.astype(np.int64).T.copy(), cells.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(hashed: int = HASHED, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((hashed, dims))


def document_points(texts: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """The projected hashed bigram frequencies of each text; an empty text is the origin."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for k, t in enumerate(texts):
        if t:
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            pair = (b[:-1] * 257 + b[1:]) if b.size > 1 else b
            out[k] = np.bincount((pair * 40503 >> 4) & (len(matrix) - 1), minlength=len(matrix)) @ matrix / pair.size
    return out


def document_keys(texts: list[bytes], matrix: np.ndarray) -> np.ndarray:
    side = 1 << BITS
    cells = np.clip((document_points(texts, matrix) + 0.5) * side, 0, side - 1).astype(np.int64)
    return hilbert_key(cells, BITS)


class Encoder:
    """Ids of a byte-level tokenizers file whose ids follow its merge order.

    Text of Latin letters goes through the same vocabulary in tiktoken, which is four times as fast; other
    text, for which the two may class a character differently, through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: byte-level pre-tokenization
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        if not raw.size:
            return np.zeros(0, np.uint32)
        if raw.max() > 0xC8:  # a character from U+0240 on
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection()
        for b in slices(batches):
            text = b.column("text")
            key = document_keys([t or b"" for t in text.cast(pa.binary()).to_pylist()], matrix)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, pa.array(key)], ["doc_id", "text", "curve"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, used = Encoder(tokenizer), TaskContext.get().partitionId() << 32, 0
        last, ids = None, np.zeros(1, np.uint32)
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text is None or text != last:  # copies are neighbours on the curve
                    last, ids = text, np.append(encode(text or ""), np.uint32(0))
                raw, start = ids.astype("<u4").tobytes(), 0
                while start < ids.size:
                    n = min(length - used, ids.size - start)
                    rows.append((doc, start, n, raw[4 * start : 4 * (start + n)], ids.size, at, used))
                    start, used = start + n, used + n
                    if used == length:
                        at, used = at + 1, 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(keyed, "doc_id long, text string, curve long")
    rows = rows.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "text")
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
