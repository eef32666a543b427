"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch that are not known yet are held as one ragged array of symbol ids. Each round
finds every sequence's lowest-rank adjacent pair and merges all its occurrences, left to right, in all
sequences at once, until no pair has a rank. A merge can only make pairs of a higher rank than its own
(the merge list holds a symbol's own merge before any merge that uses it), so this gives what merging one
pair at a time gives. The surviving symbols are counted; nothing else of the tokens is kept.

Normalization, splitting and special strings follow the vocabulary file (NFC, lower case, letters, single
digits, runs of other characters; special strings in a text are one token each). Null text is empty text:
no bytes, no tokens. Repeated rows keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Known pre-tokens that a worker keeps; beyond that it starts anew.
CACHE = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merger:
    """A byte-level BPE vocabulary file (tokenizers JSON with an end-of-word suffix) as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.size = len(vocab)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[alphabet[b] + end] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.none = len(pairs)
        split = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"][0]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
        self.marks = special
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def lengths(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size) - 1
        sym = self.inner[data]
        sym[ends] = self.final[data[ends]]
        owner, count = np.repeat(np.arange(len(words)), size), size.copy()
        rank = self._pair_ranks(sym, owner)
        while sym.size:
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            many = np.diff(np.append(starts, sym.size))
            done = least == self.none
            count[owner[starts[done]]] = many[done]
            live = np.repeat(~done, many)
            if not live.any():
                break
            floor = np.repeat(np.where(done, -1, least), many)
            hit = rank == floor
            at = np.flatnonzero(hit)
            # of a run of overlapping occurrences every second one is taken, from the left
            run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)]) if at.size else at
            first = np.searchsorted(run, np.arange(run[-1] + 1)) if at.size else at
            at = at[(np.arange(at.size) - first[run]) % 2 == 0] if at.size else at
            sym[at] = self.made[rank[at]]
            gone = np.zeros(sym.size, bool)
            gone[at + 1] = True
            stale = np.zeros(sym.size, bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            # the symbol before a merged one may itself have gone; its own left part is stale already
            keep = live & ~gone
            sym, owner, rank, stale = sym[keep], owner[keep], rank[keep], stale[keep]
            redo = np.flatnonzero(stale)
            prior = redo[redo > 0] - 1
            redo = np.union1d(redo, prior)
            nxt = np.minimum(redo + 1, sym.size - 1)
            ok = (redo + 1 < sym.size) & (owner[nxt] == owner[redo])
            rank[redo] = np.where(ok, self.ranks(sym[redo], sym[nxt]), self.none)
        return count

    def _pair_ranks(self, sym: np.ndarray, owner: np.ndarray) -> np.ndarray:
        rank = np.full(sym.size, self.none, np.int64)
        if sym.size > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same] = self.ranks(sym[same], sym[same + 1])
        return rank

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        parts, extra = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            t = t or ""
            if any(m in t for m in self.marks):
                pieces = self.special.split(t)
                extra[k] = len(pieces) - 1
                words = [w for p in pieces for w in self.words(_normal(p))]
            else:
                words = self.words(_normal(t))
            parts.append(words)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        if new := [w for w in {w for p in parts for w in p} if w not in known]:
            known.update(zip(new, self.lengths(new).tolist()))
        get = known.__getitem__
        return extra + np.fromiter((sum(map(get, p)) for p in parts), np.int64, len(parts))


def _normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to the word's end
    return text.lower()


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; `vocabulary` is a path that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(vocabulary)
        for b in slices(batches):
            text = b.column("text")
            size = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(merger.count(text.to_pylist()))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)
