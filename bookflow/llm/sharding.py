"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of one key) are sized in Spark. Groups of at least one `grain` of bytes are items by
themselves; smaller ones are hashed into parcels of about a grain. A group larger than a whole bin cannot
stay in one piece: its rows, repeated ones too, are dealt into cuts of about a grain by their row numbers.
Items are sorted by size, largest first, and each enters the open bin with the least remaining capacity that
holds it, found in a balanced tree; a new bin opens where none does.

Near-equal shards: the smallest capacity that suffices leaves the last bins short, so items then move or change
places between the fullest or emptiest bin and another as long as that brings the two nearer to each other. There
are at most a few items per grain, `grains` grains a shard, so one task packs them whatever the input. Bins of a fixed capacity: as many as the data fill, so items are dealt by hash into classes
of about `AT_ONCE` bins, each packed by a task of its own, at the price of one open bin a class.

Rules: null text is a group of its own with size 1 a row; equal texts are one group; repeated rows are
rows; other columns are ignored; an empty table gives an empty table. Slots count from 0 in each shard:
an item's rows are numbered in buckets of bounded size, bucket offsets are sums over the bucket table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

GRAINS, BUCKET = 1024, 4096
#: Bins of a class and grains of a bin at a fixed capacity; groups looked up by broadcast.
AT_ONCE, FINE, NAMED = 256, 64, 1 << 16


class Tree:
    """A balanced search tree (treap) of distinct pairs."""

    def __init__(self) -> None:
        self.root, self.dice = None, random.Random(0)

    @staticmethod
    def _split(node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = Tree._split(node[2], key)
            return node, right
        left, node[1] = Tree._split(node[1], key)
        return left, node

    @staticmethod
    def _join(a, b):
        if a is None or b is None:
            return a or b
        if a[3] < b[3]:
            a[2] = Tree._join(a[2], b)
            return a
        b[1] = Tree._join(a, b[1])
        return b

    def add(self, key) -> None:
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, [key, None, None, self.dice.random()]), right)

    def take(self, key):
        """Removes and returns the least pair from key on, if any."""
        left, right = self._split(self.root, key)
        if right is None:
            self.root = left
            return None
        first = right
        while first[1] is not None:
            first = first[1]
        _, right = self._split(right, (first[0][0], first[0][1] + 1))
        self.root = self._join(left, right)
        return first[0]


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each item, and how many bins there are. An item over the capacity is an error."""
    if sizes and max(sizes) > capacity:
        raise ValueError("an item is larger than a bin")
    tree, bins, out = Tree(), 0, [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take((sizes[k], -1))
        if found is None:
            found, bins = (capacity, bins), bins + 1
        out[k] = found[1]
        tree.add((found[0] - sizes[k], found[1]))
    return out, bins


def tightest(sizes: list[int], shards: int) -> list[int]:
    """The bins of the smallest capacity, to a thousandth of a mean bin, at which best-fit-decreasing needs no more than `shards`."""
    low = max(-(-sum(sizes) // shards), max(sizes, default=1))
    step = max(1, low // 1000)
    best, lo, hi = None, 0, 1
    while best is None:
        got, n = best_fit_decreasing(sizes, low + hi * step)
        best, lo, hi = (got, lo, hi) if n <= shards else (None, hi, 2 * hi)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        got, n = best_fit_decreasing(sizes, low + mid * step)
        best, lo, hi = (got, lo, mid) if n <= shards else (best, mid, hi)
    return best


def levelled(sizes: list[int], bins: list[int], shards: int) -> list[int]:
    """The bins after moves and exchanges of items that even them out: until they differ by a thousandth of a mean bin, or no such step between an outermost bin and another makes the two more alike."""
    size, home = np.array(sizes, np.int64), np.array(bins, np.int64)
    load = np.bincount(home, size, shards).astype(np.int64)
    slack = int(load.sum()) // shards // 1000
    while True:
        order = np.argsort(load, kind="stable")
        low, high = int(order[0]), int(order[-1])
        if load[high] - load[low] <= slack:
            return home.tolist()
        for full, short in [(int(f), low) for f in order[:0:-1]] + [(high, int(e)) for e in order[1:-1]]:
            gap = int(load[full] - load[short])
            if gap <= 1:
                continue
            mine, theirs = np.flatnonzero(home == full), np.flatnonzero(home == short)
            theirs = theirs[np.argsort(size[theirs], kind="stable")]
            back = np.r_[0, size[theirs]]  # 0: nothing comes back
            at = np.searchsorted(back, size[mine] - gap / 2)
            best = None
            for k in (np.maximum(at - 1, 0), np.minimum(at, back.size - 1)):
                moved = size[mine] - back[k]
                miss = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), gap)
                i = int(miss.argmin())
                if miss[i] < gap and (best is None or miss[i] < best[0]):
                    best = (int(miss[i]), int(moved[i]), int(mine[i]), int(k[i]))
            if best:
                _, moved, out, k = best
                home[out] = short
                if k:
                    home[theirs[k - 1]] = full
                load[full] -= moved
                load[short] += moved
                break
        else:
            return home.tolist()


def _packed(shards: int, capacity: int | None):
    """Packs the items of a class: into `shards` bins, or as many of the capacity as it takes."""

    def run(items: pa.Table) -> pa.Table:
        items = items.sort_by([("kind", "ascending"), ("item", "ascending"), ("cut", "ascending")])
        sizes = items.column("bytes").to_pylist()
        bins = levelled(sizes, tightest(sizes, shards), shards) if capacity is None else best_fit_decreasing(sizes, capacity)[0]
        return items.append_column("bin", pa.array(bins, pa.int32()))

    return run


def shard(docs: DataFrame, shards: int = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", grains: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: into `shards` near-equal shards, or into as few of `capacity` bytes as best-fit-decreasing needs. A row larger than the capacity is an error."""
    text = F.col(text_col)
    grains = grains or (GRAINS if capacity is None else FINE)
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    bin_size = -(-total // shards) if capacity is None else capacity
    grain = max(1, bin_size // grains)
    classes = 1 if capacity is None else -(-total // (capacity * AT_ONCE)) or 1
    parcels = max(1, total // grain)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    named = materialize(
        groups.where(F.col("bytes") >= grain).select(
            F.col("key").alias("of"), "bytes", F.xxhash64("key").alias("named"), F.when(F.col("bytes") > bin_size, F.ceil(F.col("bytes") / F.lit(grain)).cast("int")).otherwise(F.lit(1)).alias("cuts")
        )
    )
    # groups of a grain or more: at most one a grain. The largest ones are broadcast, at most NAMED; each other one is
    # too small a part of the rows to be a hot key of a join. The hash of any other key is its place.
    bound = max(grain, total // NAMED)
    own = ["row", "doc_id", "size", "text_crc32", "key"]
    full = rows.join(F.broadcast(named.where(F.col("bytes") >= bound).drop("bytes")), F.col("key") == F.col("of"), "left").drop("of")
    if bound > grain:
        rest = named.where(F.col("bytes") < bound).select("of", F.col("named").alias("_named"), F.col("cuts").alias("_cuts"))
        full = full.join(rest, F.col("key") == F.col("of"), "left").select(*own, F.coalesce("named", "_named").alias("named"), F.coalesce("cuts", "_cuts").alias("cuts"))
    kind = F.when(F.col("named").isNull(), 0).when(F.col("cuts") > 1, 2).otherwise(1)
    cut = F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("row"), F.col("cuts"))).otherwise(F.lit(0)).cast("long")
    item = F.coalesce("named", F.pmod(F.xxhash64("key"), F.lit(parcels)))
    placed = materialize(full.select("row", "doc_id", "size", "text_crc32", kind.alias("kind"), item.alias("item"), cut.alias("cut")))
    items = placed.groupBy("kind", "item", "cut").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    items = items.withColumn("class", F.pmod(F.xxhash64("kind", "item", "cut"), F.lit(classes)).cast("int"))
    packed = materialize(items.groupBy("class").applyInArrow(_packed(shards, capacity), "kind int, item long, cut long, bytes long, n long, class int, bin int"))
    # a row a class: bins of the classes before
    bins = packed.groupBy("class").agg(F.max("bin").alias("last"))
    before = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    first = bins.select("class", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).cast("int").alias("first"))
    home = packed.join(F.broadcast(first), "class").select("kind", "item", "cut", (F.col("first") + F.col("bin")).alias("shard"), F.ceil(F.col("n") / F.lit(BUCKET)).cast("long").alias("buckets"))
    home = F.broadcast(home) if parcels <= NAMED else home
    dealt = placed.join(home, ["kind", "item", "cut"]).withColumn("bucket", F.pmod(F.xxhash64("row", F.lit("bucket")), F.col("buckets")))
    key = ["shard", "kind", "item", "cut", "bucket"]
    counts = dealt.groupBy(*key).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("kind", "item", "cut", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "row")
    numbered = dealt.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(offsets, key).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k")).alias("slot"))


def op8(spark, sf_dir: str) -> DataFrame:
    done = shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
