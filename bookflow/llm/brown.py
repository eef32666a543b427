"""Brown class-based bigram scoring.

All counts cover every training document. Word counts are a Spark aggregation and may grow with the corpus
without bound; only a head of them (`HEAD` words, a parameter) is broadcast, the counts of all other words
meet their occurrences in a join.

Classes: items are the head words seen `LOW` times or more, and for every other word, whose few neighbours say
nothing about unseen ones, the ending of its last two characters (the `SUFFIXES` most frequent endings of such
words, one item for the rest). Exchange clustering
moves an item to the class where it gains most likelihood of the class bigrams:

* the bigrams of items are counted once over the corpus, into a table with a row per item: its neighbours and their counts;
* the `TOP` most frequent words move one at a time, from their dense bigram counts, until none moves;
* then all items move in sweeps over that table, which needs no shuffle: each item's best class is found by the same gain against the
  class bigrams as they stand. In the first sweep every item
  outside the top enters its best class. In later ones a half of the items, another each time, may move; as neighbours that move
  together do not see each other, the moves are tried all at once, then the half of most gain and so on (`HALVINGS`), until the
  likelihood of the class bigrams, counted anew, rises; if it does not, the classes stay. Sweeps end when two in a row bring less
  than `LEVEL` of the likelihood each, or after `SWEEPS`.

So no sweep lowers the likelihood, and each word has a class, by itself or by its ending; the end of a text has its own. What is
broadcast and collected is bounded by items x classes, parameters both.

    P(word | words before) = P(class | class before) * (c + 1) / (T + U + 1)

where T and U are the tokens and distinct words of the word's class in training (one share is left for the
class's unseen words) and class transitions are smoothed towards class frequencies. A document's score is
the log10 probability of its tokens, its end included. The base score is the add-one unigram's.

Rules: null text is empty text, one end token; a null id counts as a training document; repeated rows are
counted and scored each; with nothing to learn from every word is unseen; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table

HEAD, TOP, SUFFIXES, CLASSES, SWEEPS, LEVEL, LOW, HALVINGS = 65_536, 512, 4096, 64, 8, 0.0005, 8, 2
#: Words and bigrams that a task holds before it passes their counts on.
KEPT, HELD = 300_000, 1 << 22
_END = b"\n"  # no word holds a line break


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over the texts; tasks add up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return r

        for b in slices(batches):
            for t in b.column("text").to_pylist():
                held.update(_words(t))
            if len(held) > KEPT:
                yield out()
        yield out()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _log(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def gains(r: np.ndarray, l: np.ndarray, s: float, base: np.ndarray) -> np.ndarray:  # noqa: E741
    """By how much the class bigrams' likelihood rises as an item enters each class: r, l count the item before and after each class without itself, s itself after itself, base the bigrams of classes without the item."""
    rows, cols = base.sum(1) + l, base.sum(0) + r  # whichever class it enters
    x, y = np.flatnonzero(r), np.flatnonzero(l)  # most items have few neighbours' classes
    after, before = base[:, x], base[y].T
    out = (_log(after + r[x]) - _log(after)).sum(1) + (_log(before + l[y]) - _log(before)).sum(1)
    d = np.diagonal(base)
    out += _log(d + r + l + s) - _log(d) - (_log(d + r) - _log(d)) - (_log(d + l) - _log(d))
    return out - (_log(rows + r.sum() + s) - _log(rows) + _log(cols + l.sum() + s) - _log(cols))


def without(r: np.ndarray, l: np.ndarray, s: float, a: int, both: np.ndarray) -> np.ndarray:  # noqa: E741
    """The class bigrams without an item of class a; its own pair is taken out of r and l first, in place."""
    r[a] -= s
    l[a] -= s
    base = both.copy()
    base[a] -= r
    base[:, a] -= l
    base[a, a] -= s
    return base


def exchange(counts: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """The class of each item by exchange clustering of item bigram counts (I, I), until no item moves or `sweeps`. Items start dealt by frequency; the last item keeps the last class to itself."""
    w = counts.astype(np.float64)
    n = len(w)
    k = max(1, min(classes - 1, n - 1))
    order = np.argsort(-(w.sum(0) + w.sum(1))[:-1], kind="stable")
    cls = np.full(n, k)
    cls[order] = np.arange(n - 1) % k
    one = np.zeros((n, k + 1))
    one[np.arange(n), cls] = 1
    right, left = w @ one, w.T @ one  # item followed by class, item preceded by class
    both = one.T @ right
    done = 0
    while sweeps is None or done < sweeps:
        moved, done = 0, done + 1
        for i in order:
            a, s = cls[i], w[i, i]
            r, l = right[i].copy(), left[i].copy()  # noqa: E741
            if not r.any() and not l.any():
                continue
            base = without(r, l, s, a, both)
            gain = gains(r, l, s, base)
            b = int(np.argmax(gain[:k]))
            if gain[b] <= gain[a] + 1e-6:  # each move raises the likelihood, so the moves end
                continue
            moved += 1
            both = base
            both[b] += r
            both[:, b] += l
            both[b, b] += s
            cls[i] = b
            right[:, a] -= w[:, i]
            right[:, b] += w[:, i]
            left[:, a] -= w[i]
            left[:, b] += w[i]
        if not moved:
            break
    return cls


def _ending(word: bytes) -> str:
    return word.decode("utf-8", "replace")[-2:]


class Model:
    """What scoring needs: head words with counts, endings, classes, totals. Its size is bounded by the parameters."""

    def __init__(self, head: list[tuple[bytes, int]], low: int, endings: list[tuple[str, int, int]], rest: tuple[int, int], documents: int, tokens: int, distinct: int):
        """head by falling count; endings: (ending, tokens, words) of words that are no items; rest: tokens and words of all other endings."""
        self.index = {w: k for k, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head] + [0], np.float64)
        self.documents, self.tokens, self.distinct = documents, tokens, distinct
        self.own = sum(c >= low for _, c in head)
        self.suffix = {e: self.own + k for k, (e, _, _) in enumerate(endings)}
        self.other = self.own + len(endings)
        self.end = self.other + 1
        self.size = self.end + 1
        self.item = np.array([k if k < self.own else self.of_ending(w) for k, (w, _) in enumerate(head)] + [-1], np.int64)
        self.item_tokens = np.array([c for _, c in head[: self.own]] + [n for _, n, _ in endings] + [rest[0], documents], np.float64)
        self.item_words = np.array([1] * self.own + [u for _, _, u in endings] + [rest[1], documents > 0], np.float64)

    def of_ending(self, word: bytes) -> int:
        return self.suffix.get(_ending(word), self.other)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head numbers (the last stands for words outside the head) and items."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        items = self.item[at]
        if (out := np.flatnonzero(at < 0)).size:
            items[out] = [self.of_ending(words[k]) for k in out.tolist()]
        return at, items

    def sequence(self, texts: list[str | None]) -> np.ndarray:
        """The items of all texts; an end stands before and after each."""
        end = np.array([self.end])
        parts = [end]
        for t in texts:
            parts += [self.encode(_words(t))[1], end]
        return np.concatenate(parts).astype("<i4")

    def classify(self, cls: np.ndarray, bigrams: np.ndarray) -> None:
        """Sets the classes and, from their bigrams, what scoring looks up."""
        self.cls = cls
        k = len(bigrams)
        tokens, words = np.bincount(cls, self.item_tokens, k), np.bincount(cls, self.item_words, k)
        prior = (tokens + 1) / (tokens + 1).sum()
        self.step = np.log10((bigrams + 2 * prior) / (bigrams.sum(1, keepdims=True) + 2))
        self.emit = np.log10(tokens + words + 1)
        self.emit[cls[self.end]] = math.log10(self.documents + 1)  # an end is all that its class holds

    def score(self, text: str | None) -> tuple[int, int, float, float, list[dict]]:
        """Tokens, known head tokens, sum of log10(c + 1) over head tokens and the end, class part, words outside the head with their number."""
        words = _words(text)
        at, items = self.encode(words)
        c = self.cls[np.concatenate([[self.end], items, [self.end]])]
        inside = at >= 0
        counts = math.fsum(np.log10(self.count[at[inside]] + 1).tolist()) + math.log10(self.documents + 1)
        part = float(self.step[c[:-1], c[1:]].sum() - self.emit[c[1:]].sum())
        rare = Counter(words[k] for k in np.flatnonzero(~inside).tolist())
        return len(words) + 1, int(inside.sum()) + (self.documents > 0), counts, part, [{"word": w, "k": k} for w, k in rare.items()]


def item_bigrams(train: DataFrame, shared) -> DataFrame:
    """(a, b, n): how often item b follows item a in the texts; tasks add up their own first. shared: the broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held, n = shared.value.size, [], 0

        def out() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(count)], ["a", "b", "n"])

        for b in slices(batches):
            seq = shared.value.sequence(b.column("text").to_pylist()).astype(np.int64)
            held.append(seq[:-1] * size + seq[1:])
            n += len(seq)
            if n >= HELD:
                yield out()
                n = 0
        yield out()

    return train.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


_ITEMS = "item int, after binary, after_n binary, before binary, before_n binary"


def neighbours(pairs: DataFrame) -> DataFrame:
    """A row per item: the items after it with their counts, and those before it. No row is longer than there are items."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by item; an item may go on in the next batch."""
        held: list[np.ndarray] = []

        def out(x: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(x[0])) + 1
            parts = np.split(x, cuts, axis=1) if x.shape[1] else []
            side = lambda p, after: p[:, p[3] == after]
            cols = [[int(p[0, 0]) for p in parts]]
            for after in (1, 0):
                cols += [[side(p, after)[1].astype("<i4").tobytes() for p in parts], [side(p, after)[2].astype("<i8").tobytes() for p in parts]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [c.split()[0] for c in _ITEMS.split(", ")])

        for b in batches:
            held.append(np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("item", "other", "n", "after")]))
            if held[0][0, 0] != held[-1][0, -1]:
                x = np.concatenate(held, axis=1)
                last = int(np.searchsorted(x[0], x[0, -1]))
                held[:] = [x[:, last:]]
                yield out(x[:, :last])
        yield out(np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64))

    side = lambda item, other, after: pairs.select(F.col(item).alias("item"), F.col(other).alias("other"), "n", F.lit(after).alias("after"))
    both = side("a", "b", 1).union(side("b", "a", 0))
    return both.repartition("item").sortWithinPartitions("item").mapInArrow(pack, _ITEMS)


def _sides(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for item, *raw in zip(*(c.to_pylist() for c in b.columns)):
        yield (item, *(np.frombuffer(x, t).astype(np.int64) for x, t in zip(raw, ("<i4", "<i8", "<i4", "<i8"))))


def _class_counts(other: np.ndarray, n: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    c = own[other]
    return np.bincount(c[c >= 0], n[c >= 0], k)


def class_bigrams(items: DataFrame, cls: np.ndarray, k: int) -> np.ndarray:
    """(k, k) bigrams of classes; items without a class yet (-1) are left out."""
    shared = items.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, k))
        for b in batches:
            for item, after, n, _, _ in _sides(b):
                if shared.value[item] >= 0:
                    held[shared.value[item]] += _class_counts(after, n, shared.value, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(held), pa.list_(pa.float64()))], ["of", "n"])

    out = np.zeros((k, k))
    for r in items.mapInArrow(run, "of long, n array<double>").select("of", F.posexplode("n").alias("at", "n")).groupBy("of", "at").agg(F.sum("n").alias("n")).where("n > 0").collect():
        out[r.of, r.at] = r.n
    return out


def top_bigrams(items: DataFrame, m: int, end: int) -> np.ndarray:
    """(m + 1, m + 1) bigrams of the first m items and, last, the end."""
    out = np.zeros((m + 1, m + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for item, after, n, _, _ in _sides(b):
                if item < m or item == end:
                    keep = (after < m) | (after == end)
                    rows.append(m if item == end else item)
                    found.append(np.bincount(np.where(after[keep] == end, m, after[keep]), n[keep], m + 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["of", "n"])

    for r in items.mapInArrow(run, "of long, n array<double>").collect():  # a row an item, m + 1 of them
        out[r.of] = r.n
    return out


def likelihood(both: np.ndarray) -> float:
    """Of class bigrams, up to what does not depend on the classes."""
    return float(_log(both).sum() - _log(both.sum(0)).sum() - _log(both.sum(1)).sum())


def sweep(items: DataFrame, cls: np.ndarray, both: np.ndarray, turn: int) -> list:
    """(item, class, gain) of the items that would move, or enter, by the gain against the class bigrams `both`; at most one row an item."""
    k = len(both)
    shared = items.sparkSession.sparkContext.broadcast((cls, both))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = shared.value
        for batch in batches:
            moved: list[tuple[int, int, float]] = []
            for item, after, after_n, before, before_n in _sides(batch):
                a = int(own[item])
                if a == k - 1 or (a >= 0 and (item * 2654435761 + turn * 40503 * 65537 >> 9) & 1):
                    continue  # the end, or the half that waits
                r, l = _class_counts(after, after_n, own, k), _class_counts(before, before_n, own, k)  # noqa: E741
                s = float(after_n[after == item].sum()) if a >= 0 else 0.0
                gain = gains(r, l, s, without(r, l, s, a, base) if a >= 0 else base)[: k - 1]
                b = int(np.argmax(gain)) if r.any() or l.any() else item % (k - 1)
                if a < 0 or gain[b] > gain[a] + 1e-6:
                    moved.append((item, b, float(gain[b] - gain[max(a, 0)])))
            cols = [pa.array([x[c] for x in moved], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["item", "to", "gain"])

    got = items.mapInArrow(move, "item long, to long, gain double").collect()
    return sorted(((r.item, r.to, r.gain) for r in got), key=lambda r: (-r[2], r[0]))


def cluster(items: DataFrame, size: int, top: int, classes: int, sweeps: int = SWEEPS, seen: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The class of each item (the last item, the end, has the last class to itself) and the class bigrams. seen: gets the likelihood once all items have a class, then after each sweep."""
    m = min(top, size - 1)

    cls = np.full(size, -1)
    first = exchange(top_bigrams(items, m, size - 1), classes)
    k = int(first[-1]) + 1
    cls[:m], cls[-1] = first[:-1], k - 1
    for item, to, _ in sweep(items, cls, class_bigrams(items, cls, k), 0):
        cls[item] = to if cls[item] < 0 else cls[item]
    cls[cls < 0] = np.flatnonzero(cls < 0) % max(1, k - 1)  # items without any bigram
    both = class_bigrams(items, cls, k)
    reached = likelihood(both)
    seen = [] if seen is None else seen
    seen.append(reached)
    part = little = 0
    for turn in range(1, sweeps):
        moved, rise = sweep(items, cls, both, turn), 0.0
        for part in range(max(0, part - 1), HALVINGS + 1):  # from twice the share that rose last
            tried = moved[: -(-len(moved) // 2**part)]
            if not tried:
                break
            new = cls.copy()
            new[[i for i, _, _ in tried]] = [to for _, to, _ in tried]
            new_both = class_bigrams(items, new, k)
            if (got := likelihood(new_both)) > reached:
                cls, both, rise, reached = new, new_both, got - reached, got
                break
        seen.append(reached)
        little = little + 1 if rise < LEVEL * abs(reached) else 0
        if little == 2:
            break
    return cls, both


def learn(train: DataFrame, counts: DataFrame, head: int = HEAD, top: int = TOP, suffixes: int = SUFFIXES, classes: int = CLASSES, sweeps: int = SWEEPS, low: int = LOW, seen: list[float] | None = None) -> Model:
    """The model of training texts with their materialized word counts."""
    documents = train.count()
    total = counts.agg(F.count("*").alias("u"), F.sum("n").alias("n")).first()
    names = materialize(counts.orderBy(F.desc("n"), "word").limit(head))
    first = names.orderBy(F.desc("n"), "word").toArrow().to_pydict()
    outside = counts.join(F.broadcast(names.where(F.col("n") >= low).select("word")), "word", "left_anti")
    ends = materialize(outside.groupBy(F.expr("right(decode(word, 'UTF-8'), 2)").alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("u")))
    kept = ends.orderBy(F.desc("n"), "e").limit(suffixes).toArrow().to_pydict()
    every = ends.agg(F.sum("n"), F.sum("u")).first()
    rest = tuple((x or 0) - sum(kept[c]) for x, c in zip(every, ("n", "u")))
    model = Model(list(zip(first["word"], first["n"])), low, list(zip(kept["e"], kept["n"], kept["u"])), rest, documents, (total.n or 0) + documents, total.u + (documents > 0))
    shared = train.sparkSession.sparkContext.broadcast(model)

    items = materialize(neighbours(item_bigrams(train, shared)))  # read by every sweep
    model.classify(*cluster(items, model.size, min(top, model.own), classes, sweeps, seen))
    return model


def perplexity(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs by a model of train."""
    own = lambda d: d.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs, train = own(docs), own(train)
    counts = materialize(word_counts(train))
    model = learn(train, counts, **sizes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = [list(c) for c in zip(*map(shared.value.score, b.column("text").to_pylist()))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_tokens", "n_known", "counts", "part", "rare"])

    rows = docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, counts double, part double, rare array<struct<word:binary,k:long>>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    # a word once a row, so a frequent unseen word brings no more rows than there are texts
    rare = rows.select("row", F.inline("rare")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    full = rows.drop("rare").join(rare, "row", "left")
    added = F.col("counts") + F.coalesce("more", F.lit(0.0))
    floor = math.log10(model.tokens + model.distinct + 1)
    score = added + F.col("part")
    return full.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (added - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = perplexity(docs, docs.where(~held_out("doc_id")))
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
