"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased, ASCII punctuation counts as white space, words are what remains. The benchmark is
read in blocks of bounded size, each of which is broadcast; the corpus side is only scanned, never shuffled.

1. Corpus counts: every occurrence of a benchmark word n-gram in any document is counted.
2. Seeds: from each window of `window` consecutive n-grams of an item the one rarest among those that occur
   in the corpus (the first of equals) is taken. An n-gram of no document finds nothing, so it never takes
   the place of one that an edited copy kept; a window without any that occurs has no seed. Every stretch of
   an item that some document holds thus has a seed, however common the item is. Counts are of the whole
   corpus: a copy goes unfound if, in each window where it kept n-grams, rarer ones of other copies win.
3. A document passage that holds a seed of an item is aligned with the whole item by local alignment
   (match 2, mismatch -1, gap -1 a word); the score is divided by that of an exact copy. Pairs that reach
   `threshold` are contamination: exact, edited and paraphrased copies alike. A passage is bounded by the first and
   last place of its seed in the item and by the ends of a run of near positions in the text, so a seed that repeats
   in both costs the sum of its repeats, not their product.

Rules: null texts hold nothing; an item of fewer words than an n-gram is evidence of nothing and never
matches; repeated items or rows are each compared and a pair of ids is returned once with its best score; items
or rows without an id are compared like any other, as those of the id null; ties go to the first passage; other
columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, slices, table

NGRAM, WINDOW, THRESHOLD, BLOCK_BYTES = 3, 3, 0.5, 4 << 20
MATCH, MISS, GAP = 2, -1, -1
EXACT_KEYS, _KEY_BITS = 1 << 62, (1 << 62) - 1
_PUNCT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PUNCT).split()


class Items:
    """A block of the benchmark: word ids, n-gram keys, and for each n-gram where in which items it is."""

    def __init__(self, rows: list[tuple[int | None, str | None]], n: int):
        self.n, self.vocab = n, {}
        self.ids = [i for i, t in rows]
        self.seqs = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t)], np.int64) for _, t in rows]
        # keys are numbers to the base of the vocabulary; a larger one has hashes, where an equal key is at worst a seed too many
        self.factor = len(self.vocab) + 2 if (len(self.vocab) + 2) ** n <= EXACT_KEYS else 0x1E3779B97F4A7C15
        self.sizes = np.array([s.size for s in self.seqs], np.int64)
        flat, item, place = [], [], []
        for k, s in enumerate(self.seqs):
            g = self.grams(s)
            flat.append(g)
            item.append(np.full(g.size, k))
            place.append(np.arange(g.size))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.keys, self.at = np.unique(flat, return_inverse=True)
        self.item = np.concatenate(item).astype(np.int64) if item else flat
        self.place = np.concatenate(place).astype(np.int64) if place else flat

    def grams(self, seq: np.ndarray) -> np.ndarray:
        """The key of the n-gram that starts at each position; -1 where a word is unknown."""
        if seq.size < self.n:
            return np.zeros(0, np.int64)
        parts = [seq[k : seq.size - self.n + 1 + k] for k in range(self.n)]
        key = np.zeros(parts[0].size, np.int64)
        known = np.ones(parts[0].size, bool)
        for p in parts:
            key = (key * self.factor + p) & _KEY_BITS
            known &= p > 0
        return np.where(known, key, -1)

    def hits(self, seq: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of seq that start one of the sorted keys, and which."""
        g = self.grams(seq)
        at = np.flatnonzero(g >= 0)
        if not at.size or not keys.size:
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(keys, g[at]), keys.size - 1)
        same = keys[k] == g[at]
        return at[same], k[same]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Word ids of all texts in one array with n zeros after each, and where each text starts."""
        split = [words(t) for t in texts]
        starts = np.cumsum([0] + [len(s) + self.n for s in split])
        seq = np.zeros(starts[-1], np.int64)
        get = self.vocab.get
        for a, s in zip(starts.tolist(), split):
            seq[a : a + len(s)] = np.fromiter(map(get, s, repeat(0)), np.int64, len(s))
        return seq, starts, split

    def seeds(self, counts: np.ndarray, window: int) -> np.ndarray:
        """Occurrences (indices into item and place) chosen as seeds: of each window the rarest n-gram that occurs at all."""
        rank = np.where(counts > 0, counts, np.iinfo(np.int64).max)
        chosen = []
        first = 0
        while first < self.item.size:
            last = int(np.searchsorted(self.item, self.item[first], "right"))
            c = rank[self.at[first:last]]
            span = min(window, c.size)
            own = np.unique(np.arange(c.size - span + 1) + np.lib.stride_tricks.sliding_window_view(c, span).argmin(1))
            chosen.append(first + own[counts[self.at[first + own]] > 0])
            first = last
        return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int]]:
    """For each (passage, item): the best local alignment's score over an exact copy's, and the passage position after its end."""
    out: list[tuple[float, int]] = [(0.0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        width, group = 0, []
        while at < len(order) and (not group or (len(group) + 1) * max(width, len(pairs[order[at]][0])) <= 1 << 18):
            group.append(order[at])
            width = max(width, len(pairs[order[at]][0]))
            at += 1
        height = max(len(pairs[k][1]) for k in group)
        text = np.zeros((len(group), width), np.int64)
        item = np.full((len(group), height), -1, np.int64)
        for r, k in enumerate(group):
            text[r, : len(pairs[k][0])] = pairs[k][0]
            item[r, : len(pairs[k][1])] = pairs[k][1]
        ramp = -GAP * np.arange(width, dtype=np.int32)
        prev = np.zeros((len(group), width + 1), np.int32)
        best, end = np.zeros(len(group), np.int32), np.zeros(len(group), np.int64)
        for i in range(height):
            here = np.maximum(prev[:, :-1] + np.where(text == item[:, i : i + 1], MATCH, MISS), prev[:, 1:] + GAP)
            here = np.maximum(here, 0)
            here = np.maximum.accumulate(here + ramp, axis=1) - ramp  # gaps along the passage
            top = here.argmax(1)
            score = here[np.arange(len(group)), top]
            better = score > best
            best, end = np.where(better, score, best), np.where(better, top + 1, end)
            prev = np.concatenate([np.zeros((len(group), 1), np.int32), here], 1)
        for r, k in enumerate(group):
            out[k] = (float(best[r]) / (MATCH * max(1, len(pairs[k][1]))), int(end[r]))
    return out


def _block(docs: DataFrame, items: Items, window: int, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(own.keys.size, np.int64)
        for b in slices(batches):
            seq, _, _ = own.encode(b.column("text").to_pylist())
            total += np.bincount(own.hits(seq, own.keys)[1], minlength=own.keys.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    counts = np.zeros(items.keys.size, np.int64)
    # no more rows than the block has n-grams
    for r in docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    seeds = spark.sparkContext.broadcast(items.seeds(counts, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chosen = shared.value, seeds.value
        keys, of, item, low, high = _places(own, chosen)
        ends = np.searchsorted(of, np.arange(keys.size + 1))
        for b in slices(batches):
            seq, starts, split = own.encode(b.column("text").to_pylist())
            doc, key, head, tail = _runs(own, starts, *own.hits(seq, keys))
            many = ends[key + 1] - ends[key]
            run = np.repeat(np.arange(key.size), many)
            at = ends[key[run]] + np.arange(run.size) - np.repeat(np.cumsum(many) - many, many)
            size = own.sizes[item[at]]
            pad = own.n + size // 2
            lo = np.maximum(0, head[run] - high[at] - pad)
            hi = np.minimum((np.diff(starts) - own.n)[doc[run]], tail[run] - low[at] + size + pad)
            spans = _merged(doc[run], item[at], lo, hi)
            # a group of passages at a time: a text may hold very many
            for k in range(0, len(spans), 2000):
                yield _rows(own, spans[k : k + 2000].tolist(), seq, starts, split, b.column("doc_id"), threshold)

    return docs.mapInArrow(search, "doc_id long, item_id long, score double, start_word long, end_word long, passage string")


def _places(own: Items, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """The seeds' keys, and by key a row for each item that holds it: the key's index, the item, its first and last place there."""
    keys, of = np.unique(own.keys[own.at[chosen]], return_inverse=True)
    order = np.lexsort((own.place[chosen], own.item[chosen], of))
    of, item, place = of[order], own.item[chosen][order], own.place[chosen][order]
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (item[1:] != item[:-1])][: of.size])
    last = np.r_[first[1:], of.size][: first.size] - 1
    return keys, of[first], item[first], place[first], place[last]


def _runs(own: Items, starts: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, key, first, last): positions of a key in a text, those whose passages overlap with any item as one."""
    doc = np.searchsorted(starts, pos, "right") - 1
    order = np.lexsort((pos, key, doc))
    doc, key, pos = doc[order], key[order], (pos - starts[doc])[order]
    near = own.n + 2 * (own.n + own.n // 2)  # the shortest passage: that of an item of one n-gram
    new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (pos[1:] - pos[:-1] > near)][: pos.size]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], pos.size][: first.size] - 1
    return doc[first], key[first], pos[first], pos[last]


def _merged(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows (doc, item, from, to): the union of a text's passages for an item."""
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    if not doc.size:
        return np.zeros((0, 4), np.int64)
    pair = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    shift = pair * (int(hi.max()) + 1)  # pairs apart, so that one running maximum serves all
    reach = np.maximum.accumulate(hi + shift)
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (lo[1:] + shift[1:] > reach[:-1])])
    last = np.r_[first[1:], doc.size] - 1
    return np.stack([doc[first], item[first], lo[first], (reach - shift)[last]], 1)


def _rows(own: Items, spans, seq, starts, split, ids, threshold: float) -> pa.RecordBatch:
    text = lambda s: seq[starts[s[0]] + s[2] : starts[s[0]] + s[3]]
    found = [(s, score, end) for s, (score, end) in zip(spans, align([(text(s), own.seqs[s[1]]) for s in spans])) if score >= threshold]
    back = align([(text(s)[:end][::-1], own.seqs[s[1]][::-1]) for s, _, end in found])
    cols: list[list] = [[], [], [], [], [], []]
    for (s, score, end), (_, size) in zip(found, back):
        a, b = s[2] + end - size, s[2] + end
        for c, v in zip(cols, (ids[s[0]].as_py(), own.ids[s[1]], score, a, b, b" ".join(split[s[0]][a:b]).decode())):
            c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "score", "start_word", "end_word", "passage"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, window: int = WINDOW, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, passage): the best passage of each pair that reaches the threshold."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for k in range(blocks):  # each block has about block_bytes, whatever the benchmark's size
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text")
        found = _block(docs, Items([(r.item_id, r.text) for r in part.collect()], n), window, threshold)
        out = found if out is None else out.union(found)
    rest = F.struct(F.col("score"), -F.col("start_word"), F.col("end_word"), F.col("passage"))
    best = out.groupBy("doc_id", "item_id").agg(F.max(rest).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("start_word"), "b.end_word", "b.passage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose text is not contaminated, whatever their ids."""
    rows = numbered(docs)
    found = contamination(rows.select("row", F.col("doc")[text_col].alias("text")), benchmark, id_col="row")
    bad = materialize(found.select(F.col("doc_id").alias("row")).distinct())
    return rows.join(bad, "row", "left_anti").select("doc.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
