"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits differ in at
most three bytes, so they share at least five positional bytes, and of the two halves of four bytes one
has three shared bytes at least. The inverted index therefore posts each fingerprint under the three-byte
intersections of its positional postings within each half (eight postings): every qualifying pair meets,
and a posting is 2^24 times rarer than a fingerprint, where single bytes would only be 2^8 times rarer.
Within a posting the rows are listed by their bytes at the other five positions, the lists' pairs are tallied,
pairs below five shared bytes in all go, and the Hamming distance of the rest is verified.

Rules: null or blank text has fingerprint zero and links like any other; equal fingerprints are joined
before the index, so copies are never paired; a posting of many fingerprints is cut into blocks whose
pairs are compared in separate tasks and come back as a spanning forest, not as pairs; repeated rows keep
a row each; a null doc_id links nothing by itself and gets the component of its fingerprint; other columns
are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .graph import components, forest

MAX_BITS, MIN_SHARED, BLOCK = 3, 5, 512
TRIPLES = [tuple(p for p in half if p != skip) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for skip in half]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, A-Z lower-cased, split at ASCII white space."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D split
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[k:] for k in range(words)))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (posting, bi, bj, fp, rep) sorted by the first three -> links (a, b) between representatives."""
    carry = None
    for b in batches:
        cols = [b.column(k).to_numpy() for k in ("posting", "bi", "bj", "fp", "rep")]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        carry = [c[last:] for c in cols]
        if last:
            yield _links([c[:last] for c in cols])
    if carry is not None and carry[0].size:
        yield _links(carry)


def candidates(group: np.ndarray, slot: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (rows sorted by group, all of a group under the posting of `slot`) that share `MIN_SHARED` positional bytes.

    The posting gives three. In each other position the group's rows are listed by their byte, every pair of a list
    is tallied once, and pairs that reach the rest of the minimum stay; pairs that share no byte are never formed.
    """
    n, pairs = len(fp), []
    byte = fp.view(np.uint8).reshape(-1, 8)
    given = np.zeros((len(TRIPLES), 8), bool)
    for k, triple in enumerate(TRIPLES):
        given[k, list(triple)] = True
    for p in range(8):
        rows = np.flatnonzero(~given[slot, p])
        key = group[rows] * 256 + byte[rows, p]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        left, step = np.arange(len(rows)), 1
        while True:
            left = left[left + step < len(rows)]
            left = left[key[left] == key[left + step]]
            if not left.size:
                break
            pairs.append(rows[left] * n + rows[left + step])
            step += 1
    code, tally = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64),) * 2
    code = code[tally >= MIN_SHARED - 3]
    return code // n, code % n


def _links(cols: list[np.ndarray]) -> pa.RecordBatch:
    posting, bi, bj, fp, rep = cols
    group = np.concatenate([[0], np.cumsum((posting[1:] != posting[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]))])
    n, labels = len(fp), np.arange(len(fp))
    # groups together, but no more than about a million pairs of rows at a time
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(starts, n))
    part = np.cumsum(size * size) >> 20
    cuts = [0, *starts[1:][part[1:] != part[:-1]].tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        i, j = candidates(group[a:b] - group[a], (posting[a:b] >> 24).astype(np.int64), fp[a:b])
        close = np.bitwise_count((fp[a + i] ^ fp[a + j]).view(np.uint64)) <= MAX_BITS
        labels = forest(labels, a + i[close], a + j[close])
    out = np.flatnonzero(labels != np.arange(n))
    return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[labels[out]])], ["a", "b"])


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest per posting of the links between distinct fingerprints (fp, rep)."""
    byte = lambda k: F.shiftright("fp", 8 * k).bitwiseAND(F.lit(255))
    postings = [
        F.lit(k << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c)
        for k, (a, b, c) in enumerate(TRIPLES)
    ]
    posted = fps.where("rep is not null").select(F.explode(F.array(*postings)).alias("posting"), "fp", "rep")
    size = posted.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("posting", "of")
    n_blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    met = posted.join(size, F.col("posting") == F.col("of")).select(
        "posting", "fp", "rep", F.pmod(F.xxhash64("fp"), n_blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other")
    )
    met = met.select("posting", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "fp", "rep")
    met = met.repartition("posting", "bi", "bj").sortWithinPartitions("posting", "bi", "bj")
    return met.mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    own = materialize(fingerprints(docs, id_col, text_col, words))
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(links(fps))
    named = fps.join(comp, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
