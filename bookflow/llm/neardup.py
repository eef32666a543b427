"""Near-duplicates at a shingle similarity, found with wide SimHash fingerprints.

The rule: texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more (A-Z
lower-cased, words split at ASCII white space, fewer words: the whole sequence). At that similarity two SimHash
fingerprints agree in 85% of their bits, ten differing bits of 64, so a fingerprint of `PRINTS` x 64 bits
is taken, and its positional bytes are the inverted index:

1. Equal shingle sets are one text from here on. Each is posted under the three-byte intersections of its
   positional postings within each half of each 64 bits (as in `simhash`; 8 a print). A pair at 0.8 is missed with
   a probability of 0.05, at 0.85 of 0.004, at 0.9 of 0.0001, and misses of a group's pairs are made up for by
   its other links.
2. Each text of a posting meets the posting's first one; shared positional bytes are tallied over the whole
   fingerprint, and pairs below `MIN_SHARED` (at 0.8 the mean is 51 of 192 bytes, the deviation 6) go; of the rest
   those that differ in more than `MAX_BITS` (at 0.8 the mean is 233 of 1536, the deviation 14) go before any text
   moves. Of each text's pairs the best is verified by the shingle sets themselves.
3. Texts that share postings and are of several components are tallied and filtered. Postings whose first texts
   are near each other hold the same texts over and over, so they are put on pages of bounded size: a task for each
   page gets its postings as lists and each of its texts once, and compares within postings. So what moves is a
   text for each page, not for each posting. A posting too long for that is cut into blocks of bounded size, and pairs of
   blocks are compared by tasks of their own. A large component has blocks of its own there, which don't meet each other, so a
   large group that is joined already costs a row a text.
4. What is left is verified between cells: texts whose least similar first text is the same are cut into cells of
   bounded size, pairs are held as lists under their two cells, and a task for each pair of cells gets every
   text it needs once and returns a spanning forest of the links. So the rows that move are a text for each cell it has a
   candidate in, not pairs, though many texts may be alike and below the similarity.

So a group of near copies is joined by a few links a text, and only what is apart after that is compared pair
by pair. Texts without words are equal to each other and to nothing else.

Rules: null text is empty text; rows are told apart by row number, so ids may be null or repeat; other
columns may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, slices
from .graph import components, forest
from .simhash import TRIPLES

WORDS, LEAST, PRINTS, MIN_SHARED, MAX_BITS, BLOCK = 5, 0.8, 24, 30, 281, 256
#: A cell holds about so many texts, and shingles, at most (a longer text is a cell by itself, or shares one with few).
CELL_TEXTS, CELL_SHINGLES = 128, 1 << 20
#: A posting of more than so many blocks is compared by pairs of blocks; a page holds postings of about so many blocks in all.
LONG, PAGE = 4, 64
#: A text's list of pairs of blocks has about so many of a posting at most.
OTHERS = 64
#: In place of a component: the components that have no blocks of their own.
ALONE = -1
_SALT = (np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(1, -1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[k:] for k in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64))


def wide_print(shingles: np.ndarray) -> bytes:
    """PRINTS SimHashes of a shingle set, each from hashes of its own."""
    ones = np.zeros(PRINTS * 64, np.int64)
    for a in range(0, len(shingles), 255):  # sums of 255 bits fit a byte
        x = shingles[a : a + 255, None] ^ _SALT
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingle_set(t) for t in b.column("text").to_pylist()]
        same = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_print(s) for s in sets], pa.binary())], ["row", "same", "size", "print"])


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            x = _bytes(part.column("print")).reshape(part.num_rows, PRINTS, 8).astype(np.int64)
            key = [(np.arange(PRINTS) * len(TRIPLES) + k << 24) + (x[:, :, p] << 16) + (x[:, :, q] << 8) + x[:, :, r] for k, (p, q, r) in enumerate(TRIPLES)]
            key = np.concatenate(key, 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), key.shape[1]))], ["posting", "rep"])


def _listed(size: int):
    """Rows (posting, rep), sorted -> (posting, n, lead, reps): the texts of postings of two or more as lists of at most `size`.

    lead is the posting's least text, n how many of its texts there are up to the list's end. A posting
    streams through, whatever its length; texts alone in a posting go.
    """
    size = max(size, 3)  # the first list of a longer posting has n > 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = r = np.zeros(0, np.int64)
        open_ = lead = seen = 0  # the posting that may go on, its least text and how many of its texts are in lists
        for b in chain(batches, [None]):
            if b is not None:
                p, r = np.concatenate([p, b.column("posting").to_numpy()]), np.concatenate([r, b.column("rep").to_numpy()])
            if not p.size:
                continue
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            many = np.diff(np.append(first, p.size))
            of, leads = np.repeat(np.arange(first.size), many), r[first]
            i = np.arange(p.size) - first[of]
            if seen and p[0] == open_:
                i[: many[0]] += seen
                leads[0] = lead
            end = p.size if b is None else first[-1] + many[-1] // size * size
            open_, lead, seen = p[-1], leads[-1], i[end] if end < p.size else i[-1] + 1
            at = np.flatnonzero(i[:end] % size == 0)
            long = np.diff(np.append(at, end))
            n = i[at] + long
            keep = n > 1
            reps = pa.array(r[:end][np.repeat(keep, long)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long[keep])]), pa.int32()), reps)
            yield pa.RecordBatch.from_arrays([pa.array(p[at][keep]), pa.array(n[keep]), pa.array(leads[of[at]][keep]), lists], ["posting", "n", "lead", "reps"])
            p, r = p[end:], r[end:]

    return run


def _bits(differ: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(differ).view(np.uint64)).sum(1, dtype=np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their fingerprints -> pairs that share enough positional bytes, and how many."""
    for b in batches:
        p, q = _bytes(b.column("p")), _bytes(b.column("q"))
        shared = (p == q).sum(1)
        at = np.flatnonzero((shared >= MIN_SHARED) & (_bits(p ^ q) <= MAX_BITS))
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(at)), b.column("b").take(pa.array(at)), pa.array(shared[at].astype(np.int64))], ["a", "b", "shared"])


_LISTS = "ca long, cb long, a array<long>, b array<long>, need array<long>"


def _cross(block: pa.Table) -> pa.Table:
    """Pairs across components of a pair of blocks that share enough positional bytes, as lists under their two cells."""
    rep, comp, size, cell = (block.column(k).to_numpy() for k in ("rep", "comp", "size", "cell"))
    x, left, right = _bytes(block.column("print").combine_chunks()), [], []
    for i in range(len(rep) - 1):
        j = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (np.minimum(size[i + 1 :], size[i]) >= LEAST * np.maximum(size[i + 1 :], size[i])))
        if j.size:
            j = j[(x[j] == x[i]).sum(1) >= MIN_SHARED]
            j = j[_bits(x[j] ^ x[i]) <= MAX_BITS]
            left.append(np.full(j.size, i))
            right.append(j)
    return _under_cells(*(np.concatenate([np.zeros(0, np.int64), *k]) for k in (left, right)), rep, cell)


def _cross_page(texts: pa.Table, lists: pa.Table) -> pa.Table:
    """The texts and postings of a page -> what `_cross` gives: pairs within the postings, once each."""
    order = np.argsort(texts.column("rep").to_numpy())
    rep, comp, size, cell = (texts.column(k).to_numpy()[order] for k in ("rep", "comp", "size", "cell"))
    x, found, wait, waiting = _bytes(texts.column("print").combine_chunks())[order], [np.zeros(0, np.int64)], [], 0

    def tallied() -> Iterator[np.ndarray]:
        pairs = np.unique(np.concatenate(wait))
        for lo in range(0, pairs.size, 1 << 15):
            own = pairs[lo : lo + (1 << 15)]
            p, q = (x[k] for k in np.divmod(own, len(rep)))
            yield own[((p == q).sum(1) >= MIN_SHARED) & (_bits(p ^ q) <= MAX_BITS)]

    posting, reps = lists.column("posting").to_numpy(), lists.column("reps").combine_chunks()
    posting = np.repeat(posting, reps.value_lengths().to_numpy())
    at = np.lexsort((reps.flatten().to_numpy(), posting))
    posting, member = posting[at], np.searchsorted(rep, reps.flatten().to_numpy()[at])
    cuts = np.flatnonzero(np.concatenate([[True], posting[1:] != posting[:-1], [True]]))
    for s, e in zip(cuts.tolist(), cuts[1:].tolist()):
        own = member[s:e]
        of, n = comp[own], size[own]
        if of.min() == of.max():
            continue
        i, j = np.nonzero(np.triu((of[:, None] != of) & (np.minimum(n[:, None], n) >= LEAST * np.maximum(n[:, None], n)), 1))
        wait.append(own[i] * len(rep) + own[j])
        if (waiting := waiting + i.size) >= 1 << 18:
            found += tallied()
            wait, waiting = [], 0
    if wait:
        found += tallied()
    return _under_cells(*np.divmod(np.unique(np.concatenate(found)), len(rep)), rep, cell)


def _under_cells(i: np.ndarray, j: np.ndarray, rep: np.ndarray, cell: np.ndarray) -> pa.Table:
    """Pairs of places in rep and cell as `_LISTS`."""
    i, j = np.where(cell[i] > cell[j], j, i), np.where(cell[i] > cell[j], i, j)
    order = np.lexsort((cell[j], cell[i]))
    i, j = i[order], j[order]
    ca, cb = cell[i], cell[j]
    first = np.flatnonzero(np.concatenate([[True], (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])])) if i.size else i
    cuts = np.append(first, i.size)
    need = [np.unique(rep[np.concatenate([i[s:e], j[s:e]])]) for s, e in zip(cuts, cuts[1:])]
    lists = lambda v, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int64()))
    ends = np.cumsum([0, *map(len, need)])
    return pa.table({"ca": ca[first], "cb": cb[first], "a": lists(rep[i], cuts), "b": lists(rep[j], cuts), "need": lists(np.concatenate([np.zeros(0, np.int64), *need]), ends)})


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = np.intersect1d(x, y, assume_unique=True).size
    return both >= least * (x.size + y.size - both)


def _jaccard(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                if _alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return run


def _between(least: float):
    def run(sets: pa.Table, lists: pa.Table) -> pa.Table:
        """The texts and candidate pairs of two cells -> a spanning forest of the pairs that have the similarity."""
        rep = sets.column("rep").to_numpy()
        order = np.argsort(rep)
        rep, s = rep[order], [np.frombuffer(sets.column("s")[k].as_py(), np.uint64) for k in order.tolist()]
        i, j = (np.searchsorted(rep, lists.column(k).combine_chunks().flatten().to_numpy()) for k in ("a", "b"))
        i, j = np.divmod(np.unique(np.minimum(i, j) * len(rep) + np.maximum(i, j)), len(rep))
        labels = np.arange(len(rep))
        for a, b in zip(i.tolist(), j.tolist()):
            if labels[a] != labels[b] and _alike(s[a], s[b], least):
                labels = forest(labels, np.array([a]), np.array([b]))
        out = np.flatnonzero(labels != np.arange(len(rep)))
        return pa.table({"a": rep[out], "b": rep[labels[out]]})

    return run


def _sets(need: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, s): the shingle sets of the texts (row, text) that need (need) names; only these texts move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([shingle_set(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["row", "s"])

    need = materialize(need.distinct())
    return materialize(texts.join(need, F.col("row") == F.col("need"), "left_semi").mapInArrow(run, "row long, s binary"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (row, text) have the similarity."""
    held = _sets(pairs.select(F.col("a").alias("need")).union(pairs.select("b")), texts)
    both = pairs.join(held.select(F.col("row").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("row").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_jaccard(least), "a long, b long")


def _verified_lists(lists: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): of each two cells a spanning forest of their pairs that have the similarity; the lists are of `_LISTS`.

    Lists of the same cells become one before anything is unrolled, so a text is a row once for each two cells.
    """
    joined = lambda k: F.flatten(F.collect_list(k))
    lists = materialize(lists.groupBy("ca", "cb").agg(joined("a").alias("a"), joined("b").alias("b"), F.array_distinct(joined("need")).alias("need")))
    need = materialize(lists.select("ca", "cb", F.explode("need").alias("rep")))
    held = _sets(need.select(F.col("rep").alias("need")), texts)
    sets = need.join(held, F.col("rep") == F.col("row")).select("ca", "cb", "rep", "s")
    return sets.groupBy("ca", "cb").cogroup(lists.select("ca", "cb", "a", "b").groupBy("ca", "cb")).applyInArrow(_between(least), "a long, b long")


def _cells(heads: DataFrame, stars: DataFrame) -> DataFrame:
    """(rep, home, cell): texts of one least similar first text, their home, are near each other, and are dealt to cells of bounded size."""
    home = stars.groupBy("b").agg(F.min("a").alias("home"))
    at = heads.join(home, F.col("rep") == F.col("b"), "left").select("rep", "size", F.coalesce("home", "rep").alias("home"))
    n = F.greatest(F.ceil(F.count("*") / CELL_TEXTS), F.ceil(F.sum("size") / CELL_SHINGLES))
    many = at.groupBy("home").agg(n.alias("n")).where("n > 1").select(F.col("home").alias("of"), "n")
    slot = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("n")), F.lit(0))
    return at.join(many, F.col("home") == F.col("of"), "left").select("rep", "home", F.xxhash64("home", slot).alias("cell"))


def _pages(met: DataFrame, comp: DataFrame, size: int) -> DataFrame:
    """(page, posting, reps) of the lists of postings (posting, lead, reps): pages of about `size` texts of postings.

    A page has postings whose first texts share a home, and where they fill several pages all postings of a
    first text, unless these fill pages by themselves. A posting is on one page.
    """
    lead = met.groupBy("lead").agg(F.sum(F.size("reps")).alias("n")).join(comp.select(F.col("rep").alias("lead"), "home"), "lead")
    pages = lead.groupBy(F.col("home").alias("of")).agg(F.ceil(F.sum("n") / F.lit(size)).alias("pages"))
    lead = lead.join(pages, F.col("home") == F.col("of")).select("lead", "home", "pages", F.ceil(F.col("n") / F.lit(size)).alias("parts"))
    slot = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("posting"), "parts")), "pages")
    return met.join(lead, "lead").select(F.xxhash64("home", slot).alias("page"), "posting", "reps")


def _paged(pages: DataFrame, heads: DataFrame, comp: DataFrame) -> DataFrame:
    """`_LISTS` of the pairs across components within the postings of pages (page, posting, reps)."""
    need = pages.groupBy(F.col("page").alias("of")).agg(F.array_distinct(F.flatten(F.collect_list("reps"))).alias("reps")).select("of", F.explode("reps").alias("rep"))
    texts = need.join(comp.join(heads, "rep"), "rep").select("of", "rep", "comp", "cell", "size", "print")
    return texts.groupBy("of").cogroup(pages.groupBy("page")).applyInArrow(_cross_page, _LISTS)


def _blocks(met: DataFrame, comp: DataFrame, block: int) -> DataFrame:
    """(rep, posting, own, all) of the texts in postings (posting, rep) that hold several components.

    A component of more than a block has blocks of its own, which never meet each other; the rest of a posting
    shares blocks. own is a text's block, all are the posting's, each (part, k): the component or ALONE, and a number.
    Blocks are lists of texts, so what meets by posting is a row a block, not a row a text.
    """
    # a row a text, of at most PRINTS x 8 postings, meets its component
    met = met.groupBy("rep").agg(F.collect_list("posting").alias("postings")).join(comp.select("rep", "comp"), "rep")
    # dealt by posting once, for all windows and the lists
    met = met.select("rep", "comp", F.explode("postings").alias("posting")).repartition("posting")
    many = F.count("*").over(Window.partitionBy("posting", "comp"))
    met = met.withColumn("part", F.when(many > block, F.col("comp")).otherwise(ALONE))
    place = F.row_number().over(Window.partitionBy("posting", "part").orderBy("comp", "rep"))
    met = met.withColumn("k", F.floor((place - 1) / F.lit(block)).cast("long"))
    lists = met.groupBy("posting", "part", "k").agg(F.collect_list("rep").alias("reps"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = materialize(lists.select("posting", F.struct(F.col("part").cast("long").alias("part"), "k").alias("own"), "reps", "lo", "hi"))
    apart = lists.groupBy(F.col("posting").alias("of")).agg(F.collect_list("own").alias("all"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    held = lists.select("posting", "own", "reps").join(apart.select("of", "all"), F.col("posting") == F.col("of"))
    return held.select(F.explode("reps").alias("rep"), "posting", "own", "all")


def _meet(held: DataFrame, heads: DataFrame, comp: DataFrame) -> DataFrame:
    """A row for each text and pair of blocks that its block is in, with the text's fingerprint and component.

    A text meets them once for its list of pairs of blocks; the list is cut where postings have many blocks.
    """
    other = F.explode(F.filter("all", lambda x: (x["part"] == ALONE) | (x["part"] != F.col("own.part"))))
    pairs = held.select("rep", "posting", "own", F.ceil(F.size("all") / F.lit(OTHERS)).alias("cuts"), other.alias("other"))
    at = F.struct("posting", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    lists = pairs.groupBy("rep", F.pmod(F.xxhash64("other"), "cuts").alias("cut")).agg(F.collect_list(at).alias("at"))
    return lists.join(comp, "rep").join(heads, "rep").select("rep", "comp", "cell", "size", "print", F.explode("at").alias("at")).select("at.*", "rep", "comp", "cell", "size", "print")


def groups(texts: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(row, comp) for every row of texts (row long, text string): comp is the least row of its group."""
    own = materialize(texts.select("row", "text").mapInArrow(_prints, "row long, same binary, size int, print binary"))
    first = materialize(own.groupBy("same").agg(F.min("row").alias("rep")))
    heads = materialize(own.join(first, own["row"] == first["rep"]).where("size > 0").select("rep", "size", "print"))
    posted = heads.select("rep", "print").mapInArrow(_post, "posting long, rep long")
    # sorted by posting and text, so that a pass makes the lists and no row meets another
    met = materialize(posted.repartition("posting").sortWithinPartitions("posting", "rep").mapInArrow(_listed(block), "posting long, n long, lead long, reps array<long>"))
    stars = materialize(_stars(_met_once(met, block), heads, least, block))
    best = stars.groupBy("b").agg(F.max(F.struct("shared", F.col("a").alias("a"))).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = materialize(_verified(best, texts, least))
    comp = materialize(_named(heads, links).join(_cells(heads, stars), "rep"))
    long = materialize(met.where(F.col("n") > LONG * block).select("posting").distinct())
    paged = _paged(materialize(_pages(met.where("n > 2").join(long, "posting", "left_anti"), comp, PAGE * block)), heads, comp)
    found = _meet(_blocks(met.join(long, "posting", "left_semi").select("posting", F.explode("reps").alias("rep")), comp, block), heads, comp)
    found = found.select("posting", *[F.col(f"{x}.{k}").alias(f"{x}_{k}") for x in ("bi", "bj") for k in ("part", "k")], "rep", "comp", "cell", "size", "print")
    found = found.groupBy("posting", "bi_part", "bi_k", "bj_part", "bj_k").applyInArrow(_cross, _LISTS)
    of = lambda k: comp.select(F.col("rep").alias(k), F.col("comp").alias(f"m{k}"), F.col("cell").alias(f"c{k}"))
    rest = stars.join(best, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("ma <> mb")
    rest = rest.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), F.array("a").alias("a"), F.array("b").alias("b"), F.array("a", "b").alias("need"))
    links = links.union(materialize(_verified_lists(paged.union(found).union(rest), texts, least)))
    comp = _named(first.select("rep"), links)
    return own.select("row", "same").join(first, "same").join(comp, "rep").select("row", "comp")


def _met_once(met: DataFrame, block: int) -> DataFrame:
    """(lead, n, rep) of lists (posting, n, lead, reps): a text once under its first text, not once a posting.

    Lists of a place in their postings, of which a first text has one a posting, become one before they are unrolled.
    """
    once = met.groupBy("lead", F.ceil(F.col("n") / F.lit(block)).alias("place")).agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("reps"))).alias("reps"))
    return once.select("lead", "n", F.explode("reps").alias("rep"))


def _stars(met: DataFrame, heads: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, shared): each text b of a posting with the posting's first one, a, where they share enough positional bytes.

    Fingerprints meet lists in place of pairs: a list of the texts of a first text, of bounded length as a posting
    of several blocks deals its texts to as many lists, then a list of the first texts of a text, a posting each at most.
    So a first text of many postings is no hot key, and a join makes a row a list.
    """
    pairs = met.where("rep <> lead").groupBy(F.col("lead").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n"))
    many = F.ceil(F.col("n") / F.lit(block))
    lists = pairs.groupBy("a", many.alias("many"), F.pmod(F.xxhash64("b"), many).alias("slot")).agg(F.collect_list("b").alias("bs"))
    lists = lists.select("a", "bs").join(heads.select(F.col("rep").alias("of"), F.col("print").alias("p"), F.col("size").alias("m")), F.col("a") == F.col("of"))
    firsts = lists.select(F.struct("a", "p", "m").alias("first"), F.explode("bs").alias("b")).groupBy("b").agg(F.collect_list("first").alias("firsts"))
    firsts = firsts.join(heads.select("rep", F.col("print").alias("q"), F.col("size").alias("n")), F.col("b") == F.col("rep"))
    near = F.least("x.m", "n") >= F.lit(least) * F.greatest("x.m", "n")
    return firsts.select("b", "q", "n", F.explode("firsts").alias("x")).where(near).select("x.a", "b", "x.p", "q").mapInArrow(_tally, "a long, b long, shared long")


def _named(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp) for every rep."""
    found = components(links)
    return reps.select("rep").join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs, all their columns, without near-duplicates: of each group the row of the smallest id stays, one without id only if no other has one; of rows that repeat it one stays."""
    rows = numbered(docs)
    found = materialize(groups(rows.select("row", F.col("doc")[text_col].alias("text")), least))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    ids = rows.select("row", F.col("doc")[id_col].cast("long").alias("id"))
    keep = ids.join(found, "row").groupBy("comp").agg(F.min(order).alias("k")).select(F.col("k.row").alias("row"))
    gone = materialize(found.select("row").join(keep, "row", "left_anti"))
    return rows.join(gone, "row", "left_anti").select("doc.*")
