"""Hard negatives by one-dimensional distance keys.

Rows are integer vectors; a row's score for an anchor is their inner product. With M the greatest length of any row,
a row x gets one more coordinate, sqrt(M^2 - |x|^2), and an anchor q a zero: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the
highest scores are the nearest points, and score s lies within the radius r(s) = sqrt(|q|^2 + M^2 - 2 s).

Each row belongs to its nearest pivot (up to `PIVOTS`, farthest-first in a sample of at most `SAMPLE` rows of each of the
`LENGTHS` most frequent vector lengths; all other lengths go without pivots and prune nothing). Its key is (pivot, distance to
the pivot). The table is range-sorted by key and stored in segments of bounded bytes, each an interval of keys: copies and hot pivots
just fill more segments. By the triangle inequality a row within r of an anchor at distance D from a pivot has a key in [D - r, D + r] there.

A search expands twice, both times in blocks of up to `CHUNK` anchors that are neighbours by key:

* at home: the segments around the anchors' own keys give each search a score that its k-th result must reach;
* beyond: key intervals of the radius of that score, at every pivot, are joined with the segments (a join on the pivot and
  overlap). In a segment the annulus around the anchors comes first, the scan goes outward in runs of `RUN` rows,
  the radius shrinks as results come in, and runs that no anchor's radius reaches are not read.

What lies outside all intervals cannot reach the k-th score, so the result is exact; per block of anchors and segment at most k
rows a search come back, and Spark ranks them. The same search runs for positives (k rows of the label) and for the negatives
of each positive (k rows of other labels within a window of scores). Distances carry rounding errors of up to 1e-8 M; intervals are wider by 1e-6 M.

Rules: rows with a null label or vector or any null or non-finite component take no part; vectors of different
lengths never meet; rows are told apart by row number, so repeated rows and ids are rows like any other; a row without id is no
anchor and comes last among ties, then the row number decides; components beyond (2^31 - 1) / sqrt(length) are held at
that, so that a score fits a long; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .covertree import farthest_first

PIVOTS, SAMPLE, LENGTHS = 32, 1024, 16
SEGMENT_BYTES, SEGMENT, CHUNK, RUN = 512 << 10, 4096, 512, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
WIDER = 1e-6


def integers(vector: Column) -> Column:
    """floor(256 x) of each component, x as a double, within what scores allow; null where the vector or a component is null or not finite."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = F.floor(F.lit((1 << 31) - 1) / F.sqrt(F.greatest(F.size(x), F.lit(1))))
    return F.when(sound, F.transform(x, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v, F.lit(1e15)), F.lit(-1e15)) * 256), most), -most).cast("int")))


class Pivots:
    """Pivots of the frequent vector lengths, and the squared greatest length of a row."""

    def __init__(self, square: int, points: dict[int, np.ndarray]):
        self.square = float(square)
        self.points = points

    def lifted(self, x: np.ndarray) -> np.ndarray:
        own = np.maximum(0, self.square - (x * x).sum(1))
        return np.concatenate([x, np.sqrt(own)[:, None]], 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.points.get(x.shape[1])
        if p is None:
            return np.full(len(x), -1), np.zeros(len(x))
        dot = self.lifted(x) @ p.T
        best = dot.argmax(1)
        return best, np.sqrt(np.maximum(0, 2 * self.square - 2 * dot[np.arange(len(x)), best]))

    def from_anchors(self, q: np.ndarray) -> np.ndarray:
        """(anchors, pivots) distances; an anchor's further coordinate is zero."""
        p = self.points[q.shape[1]]
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.square - 2 * q @ p[:, :-1].T))

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Within which all rows of at least that score lie."""
        known = score > LEAST
        r = np.sqrt(np.maximum(0, (q * q).sum(1) + self.square - 2.0 * np.where(known, score, 0)))
        return np.where(known, r, np.inf) + WIDER * math.sqrt(self.square)


def choose(rows: DataFrame) -> Pivots:
    """rows: (row, v, square). Collected: one number, `LENGTHS` lengths, `SAMPLE` rows of each."""
    top = rows.agg(F.max("square")).first()[0] or 0
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(LENGTHS).collect()
    own, points = Pivots(top, {}), {}
    if lengths and top:
        share = F.element_at(F.create_map(*[F.lit(x) for r in lengths for x in (r.length, min(1.0, SAMPLE / r.n))]), F.size("v"))
        lot = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.where(lot < share).withColumn("lot", lot).select("row", "v", F.row_number().over(Window.partitionBy(F.size("v")).orderBy("lot", "row")).alias("k"))
        by: dict[int, list] = {}
        for r in sample.where(F.col("k") <= SAMPLE).orderBy("row").collect():
            by.setdefault(len(r.v), []).append(r.v)
        for length, got in by.items():
            lifted = own.lifted(np.array(got, np.float64).reshape(len(got), length))
            points[length] = lifted[farthest_first(lifted / math.sqrt(top), PIVOTS)]
    return Pivots(top, points)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def place(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows with length, pivot and dist, a row's key."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            for n in np.unique(length).tolist():
                part = b.filter(pa.array(length == n))
                pivot, dist = shared.value.nearest(_matrix(part.column("v")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot, pa.int32()), pa.array(dist, pa.float64())], [*part.schema.names, "pivot", "dist"])

    rows = rows.select("row", "id", "label", "anchor", "v", F.size("v").alias("length"))
    return rows.mapInArrow(run, "row long, id long, label long, anchor boolean, v array<int>, length int, pivot int, dist double")


_SEGMENT = "block long, length int, pivot int, low double, high double, rows array<long>, ids array<long>, labels array<long>, dists array<double>, v binary"


def _pack(most: int):
    """Sorted rows -> blocks of one pivot, of at most `most` rows and about SEGMENT_BYTES of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, key = TaskContext.get().partitionId(), 0, [], None

        def out() -> pa.RecordBatch:
            nonlocal made
            b = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            made += 1
            lists = [pa.array([b.column(c).to_pylist()], t) for c, t in (("row", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("dist", pa.list_(pa.float64())))]
            raw = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in b.column("v").chunks]).astype("<i4").tobytes()
            ends = b.column("dist")[0].as_py(), b.column("dist")[b.num_rows - 1].as_py()
            head = [pa.array([x], t) for x, t in ((part << 32 | made, pa.int64()), (key[0], pa.int32()), (key[1], pa.int32()), (ends[0], pa.float64()), (ends[1], pa.float64()))]
            return pa.RecordBatch.from_arrays([*head, *lists, pa.array([raw], pa.binary())], [c.split()[0] for c in _SEGMENT.split(", ")])

        for b in batches:
            length, pivot = b.column("length").to_numpy(), b.column("pivot").to_numpy()
            at = 0
            while at < b.num_rows:
                own = (int(length[at]), int(pivot[at]))
                size = max(1, min(most, SEGMENT_BYTES // (4 * max(1, own[0]))))
                have = sum(x.num_rows for x in held)
                if held and (own != key or have >= size):
                    yield out()
                    have = 0
                key = own
                same = (length[at:] == own[0]) & (pivot[at:] == own[1])
                n = min(int(same.argmin()) if not same.all() else len(same), size - have)
                held.append(b.slice(at, n))
                at += n
        if held:
            yield out()

    return run


def packed(placed: DataFrame, most: int) -> DataFrame:
    key = ("length", "pivot", "dist", "row")
    ordered = placed.repartitionByRange(*key).sortWithinPartitions(*key)
    return materialize(ordered.select("row", "id", "label", "v", "length", "pivot", "dist").mapInArrow(_pack(most), _SEGMENT))


class Best:
    """The k best rows of each search so far, and the score that a better one must reach."""

    def __init__(self, low: np.ndarray, k: int):
        self.low, self.k = low.copy(), k
        self.found = [np.zeros(0, np.int64) for _ in range(5)]  # search, -score, id unknown, id, row

    def add(self, *found: np.ndarray) -> None:
        every = [np.concatenate(x) for x in zip(self.found, found)]
        order = np.lexsort(every[::-1])
        every = [x[order] for x in every]
        start = np.searchsorted(every[0], every[0], "left")
        keep = np.arange(len(order)) - start < self.k
        self.found = [x[keep] for x in every]
        last = np.flatnonzero((np.arange(len(order)) - start)[keep] == self.k - 1)
        self.low[self.found[0][last]] = -self.found[1][last]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors as longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(pivots: Pivots, seg: dict, chunk: dict, queries: list[dict], k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(search, row, id, id unknown, score) of the k best rows of a segment for each search, from its annulus outward."""
    v = np.frombuffer(seg["v"], "<i4").reshape(len(seg["rows"]), seg["length"])
    q = np.frombuffer(chunk["v"], "<i4").reshape(len(chunk["rows"]), chunk["length"])
    at = {r: i for i, r in enumerate(chunk["rows"])}
    own = np.array([at[x["row"]] for x in queries])
    low, high = (np.array([x[c] for x in queries], np.int64) for c in ("low", "high"))
    best = Best(low, k)
    rows, labels, dists = np.array(seg["rows"]), np.array(seg["labels"]), np.array(seg["dists"])
    unknown = np.array([x is None for x in seg["ids"]], np.int64)
    ids = np.array([0 if x is None else x for x in seg["ids"]], np.int64)
    real = q.astype(np.float64)
    far = pivots.from_anchors(real)[:, seg["pivot"]] if seg["pivot"] >= 0 else np.zeros(len(q))
    starts = np.arange(0, len(rows), RUN)
    ends = np.minimum(starts + RUN, len(rows)) - 1
    middle = float(np.median(far[own]))
    away = np.maximum(dists[starts] - middle, middle - dists[ends])
    q_rows, q_labels = np.array(chunk["rows"])[own], np.array(chunk["labels"])[own]
    for x in np.argsort(away, kind="stable"):
        a, b = starts[x], ends[x] + 1
        reach = pivots.radius(real[own], best.low)
        gap = np.maximum(dists[a] - far[own], far[own] - dists[b - 1])
        live = np.flatnonzero(gap <= reach)
        if not live.size:
            continue
        need, place = np.unique(own[live], return_inverse=True)
        s = scores(q[need], v[a:b])[place]
        ok = (s >= best.low[live, None]) & (s <= high[live, None]) & ((labels[a:b] == q_labels[live, None]) == same)
        if same:
            ok &= rows[a:b] != q_rows[live, None]
        i, j = np.nonzero(ok)
        if i.size:
            best.add(live[i], -s[i, j], unknown[a:b][j], ids[a:b][j], rows[a:b][j])
    n, minus, nul, idn, row = best.found
    return n, row, idn, nul, -minus


_FOUND = "row long, of long, found long, id long, score long"


def _scan(shared, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                seg, chunk, queries = (b.column(c)[i].as_py() for c in ("seg", "chunk", "queries"))
                n, row, idn, nul, score = search(shared.value, seg, chunk, queries, k, same)
                who = [queries[x] for x in n.tolist()]
                cols = [[w["row"] for w in who], [w["of"] for w in who], row, [None if u else x for u, x in zip(nul, idn.tolist())], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "of", "found", "id", "score"])

    return run


def _intervals(shared):
    """Blocks of anchors with their searches -> at each pivot the interval of keys that some search may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("block", "length", "pivot", "since", "until")}
            for i in range(b.num_rows):
                chunk, queries = b.column("chunk")[i].as_py(), b.column("queries")[i].as_py()
                n = chunk["length"]
                if n in shared.value.points:
                    at = {r: k for k, r in enumerate(chunk["rows"])}
                    own = np.array([at[x["row"]] for x in queries])
                    q = np.frombuffer(chunk["v"], "<i4").reshape(len(at), n).astype(np.float64)[own]
                    r = shared.value.radius(q, np.array([x["low"] for x in queries], np.int64))[:, None]
                    far = shared.value.from_anchors(q)
                    spans = list(zip(range(far.shape[1]), (far - r).min(0).tolist(), (far + r).max(0).tolist()))
                else:
                    spans = [(-1, -math.inf, math.inf)]
                for pivot, since, until in spans:
                    for c, x in zip(out, (chunk["block"], n, pivot, since, until)):
                        out[c].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int64()), ("length", pa.int32()), ("pivot", pa.int32()), ("since", pa.float64()), ("until", pa.float64())]))

    return run


class Index:
    """Segments of all rows and blocks of the anchors, both stored by key."""

    def __init__(self, rows: DataFrame):
        """rows: (id, label, anchor, v), v integers."""
        rows = rows.where("label is not null and v is not null")
        rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", (F.col("anchor") & F.col("id").isNotNull()).alias("anchor"), "v", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x).alias("square")))
        pivots = choose(rows)
        placed = materialize(place(rows, pivots))
        self.segments = packed(placed, SEGMENT)
        self.chunks = packed(placed.where("anchor"), CHUNK)
        self.anchors = self.chunks.select("block", F.explode(F.arrays_zip("rows", "ids")).alias("a")).select("block", F.col("a.rows").alias("row"), F.col("a.ids").alias("id"))
        self.shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def _met(self, queries: DataFrame, home: bool) -> DataFrame:
        """(seg, chunk, queries): the pairs of segments and blocks of anchors whose keys meet."""
        whole = lambda df: F.struct(*[c.split()[0] for c in _SEGMENT.split(", ")])
        asked = queries.join(self.anchors.select("block", "row"), "row").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "of", "low", "high"))).alias("queries"))
        chunks = self.chunks.select("block", whole(self.chunks).alias("chunk")).join(asked, "block")
        if home:
            spans = self.chunks.select("block", "length", "pivot", F.col("low").alias("since"), F.col("high").alias("until"))
        else:
            spans = chunks.mapInArrow(_intervals(self.shared), "block long, length int, pivot int, since double, until double")
        keys = self.segments.select(F.col("block").alias("seg_block"), F.col("length").alias("l"), F.col("pivot").alias("p"), "low", "high")
        pairs = spans.join(keys, (F.col("length") == F.col("l")) & (F.col("pivot") == F.col("p")) & (F.col("low") <= F.col("until")) & (F.col("high") >= F.col("since")))
        segments = self.segments.select(F.col("block").alias("seg_block"), whole(self.segments).alias("seg"))
        return pairs.select("block", "seg_block").join(chunks, "block").join(segments, "seg_block").select("seg", "chunk", "queries")

    def nearest(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, of, found, id, score, rank): for each search (row, of, low, high) the k best rows, of the anchor's label or of others, with low <= score <= high."""
        of = Window.partitionBy("row", "of").orderBy(F.desc("score"), F.asc_nulls_last("id"), "found")

        def ranked(queries: DataFrame, home: bool) -> DataFrame:
            found = self._met(queries, home).mapInArrow(_scan(self.shared, k, same), _FOUND)
            return materialize(found.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k))

        reached = ranked(queries, True).where(F.col("rank") == k).select("row", "of", F.col("score").alias("reached"))
        return ranked(queries.join(reached, ["row", "of"], "left").select("row", "of", F.greatest("low", "reached").alias("low"), "high"), False)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, floor: int = 50, ceiling: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, anchor, v), v integers.

    A negative's score lies between `floor` and `ceiling` percent of the positive's; negative positives thus have none.
    """
    index = Index(rows)
    every = index.anchors.select("row", F.lit(0).cast("long").alias("of"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    good = index.nearest(every, positives, True).where("score >= 0").select("row", F.col("id").alias("positive_id"), F.col("score").alias("of"), F.col("rank").alias("nth"))
    # hundredths without leaving a long
    share = lambda n: F.expr(f"(of div 100) * {n}"), lambda n: F.expr(f"(of % 100) * {n}")
    low = share[0](floor) + F.ceil(share[1](floor) / 100)
    high = share[0](ceiling) + F.floor(share[1](ceiling) / 100)
    windows = materialize(good.select("row", "of").distinct().select("row", "of", low.cast("long").alias("low"), high.cast("long").alias("high")))
    hard = index.nearest(windows.where("low <= high"), negatives, False)
    names = index.anchors.select("row", F.col("id").alias("anchor_id"))
    out = good.join(hard.select("row", "of", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["row", "of"]).join(names, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("of").alias("positive_score"), "negative_score")


def op12(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select(F.col("vec_id").cast("long").alias("id"), moved.cast("long").alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor"), integers(F.col("embedding")).alias("v")))
