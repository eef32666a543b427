"""Exact cosine links between vectors by a dual traversal of cover trees.

Vectors are scaled to length one, so that cosine >= c is distance <= sqrt(2 - 2c) and the triangle
inequality holds. Equal unit vectors are one point with a multiplicity. The tree's nodes are a centre and a
covering radius:

* upper levels, built in Spark: a cell of more than `block` points is split by at most `FAN` centres, which a
  bounded sample of its points gives in farthest-first order down to the level's radius (halving from 1), until
  every cell fits a block or no radius can part it. Cells, their centres and covering radii are tables.
* pairs of cells are pruned level by level, in Spark and before any vector is sent: two children of a surviving
  pair survive unless their centres are farther apart than both radii and the threshold together.
* a leaf that still has too many points is dealt into blocks by a hash, and surviving pairs of leaves become
  pairs of blocks, each compared by one task.
* lower levels, in each block: nested nets of radius 1/2, 1/4, 1/8 and 1/16. Two blocks are traversed together,
  node pair by node pair: pruned by the bound, taken whole where even the farthest two points must link,
  expanded to the next level otherwise, and at the leaves compared in double precision.

A task returns link counts and a spanning forest, never pairs. Components are found in Spark. Distances of
unstructured vectors in many dimensions are nearly equal, so no bound prunes them: there every pair of blocks is compared
and work grows with the square of the distinct vectors, as a product of matrices.

Rules: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
vectors of different lengths; rows are vectors, also where ids repeat or are null, and each row is returned; a
component's id is its smallest id, null if it has none; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import components, forest

BLOCK, FAN, SAMPLE, LEVELS = 8192, 16, 512, 8
RADII = (0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-9


def scaled(vectors: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Positions of the vectors (lists of doubles) that can link, and their unit vectors as little-endian doubles."""
    size = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()], np.int64)
    flat = vectors.flatten()  # nulls are left out here, of lists and not of components
    holes = np.asarray(flat.is_null())
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    at, out = [], []
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        place = starts[own][:, None] + np.arange(n)
        x = values[place]
        with np.errstate(all="ignore"):
            most = np.abs(x).max(1)
            good = np.isfinite(x).all(1) & (most > 0) & ~holes[place].any(1)
            x = x[good] / most[good][:, None]
            x = x / np.sqrt((x * x).sum(1))[:, None]
        at.append(own[good])
        out += [v.tobytes() for v in np.ascontiguousarray(x, "<f8")]
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    return at, out


def farthest_first(points: np.ndarray, k: int, radius: float = 0.0) -> np.ndarray:
    """Up to k indices, each the point farthest from those before it, while it is beyond the radius."""
    chosen, near = [0], points @ points[0]
    most = 1 - max(radius * radius / 2, 1e-12)
    while len(chosen) < min(k, len(points)):
        far = int(near.argmin())
        if near[far] > most:
            break
        chosen.append(far)
        near = np.maximum(near, points @ points[far])
    return np.array(chosen)


def net(points: np.ndarray, radius: float, step: int = 512) -> np.ndarray:
    """The centre of each point: centres are chosen in order, each point within the radius of an earlier centre goes to the nearest one."""
    least = 1 - radius * radius / 2
    owner = np.full(len(points), -1)
    centres = np.zeros(0, np.int64)
    for a in range(0, len(points), step):
        part = points[a : a + step]
        if centres.size:
            near = part @ points[centres].T
            best = near.argmax(1)
            done = near[np.arange(len(part)), best] >= least
            owner[a : a + step][done] = centres[best[done]]
        rest = np.flatnonzero(owner[a : a + step] < 0)
        among = part[rest] @ part[rest].T
        for i in range(rest.size):
            if owner[a + rest[i]] < 0:
                free = rest[(among[i] >= least) & (owner[a + rest] < 0)]
                owner[a + free] = owner[a + rest[i]] = a + rest[i]
        centres = np.concatenate([centres, a + np.flatnonzero(owner[a : a + step] == np.arange(a, a + len(part)))])
    return owner


def levels(points: np.ndarray) -> np.ndarray:
    """(levels, n): each point's centre at each radius; finer nets are nested in the coarser nodes, of which small ones stay whole."""
    out = [net(points, RADII[0])]
    for radius in RADII[1:]:
        sub = out[-1].copy()
        for c in np.flatnonzero(np.bincount(sub, minlength=len(points)) > 32):
            own = np.flatnonzero(out[-1] == c)
            own = np.concatenate([[c], own[own != c]])
            sub[own] = own[net(points[own], radius)]
        out.append(sub)
    return np.stack(out)


class Side:
    """A block's points with the nodes of a level: centres, members and covering radii."""

    def __init__(self, points: np.ndarray, nets: np.ndarray, weight: np.ndarray | None = None):
        self.points, self.nets = points, nets
        self.weight = np.ones(len(points), np.int64) if weight is None else weight
        self.single_precision = points.astype(np.float32)
        self.centres, node = np.unique(nets[0], return_inverse=True)
        self.members = np.split(np.argsort(node, kind="stable"), np.cumsum(np.bincount(node, minlength=len(self.centres)))[:-1]) if len(points) else []
        self.radius = covering(points, self.centres, node)
        many = np.bincount(node, minlength=len(self.centres)) > 1
        self.single, self.many = np.flatnonzero(~many), np.flatnonzero(many)


def covering(points: np.ndarray, centres: np.ndarray, node: np.ndarray) -> np.ndarray:
    cos = np.einsum("ij,ij->i", points, points[centres[node]]) if len(points) else np.zeros(0)
    out = np.zeros(len(centres))
    np.maximum.at(out, node, np.sqrt(np.maximum(0, 2 - 2 * cos)))
    return out


class Links:
    """Link counts of both sides' points, by multiplicity, and a forest over left points then right points."""

    def __init__(self, left: np.ndarray, right: np.ndarray, same: bool):
        self.left, self.right = left, left if same else right
        n = len(left) + (0 if same else len(right))
        self.n, self.same, self.shift = np.zeros(n, np.int64), same, 0 if same else len(left)
        self.labels = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Single pairs."""
        np.add.at(self.n, i, self.right[j])
        if not self.same:
            np.add.at(self.n, j + self.shift, self.left[i])
        self.labels = forest(self.labels, i, j + self.shift)

    def add_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Every point of i with every point of j."""
        self.n[i] += self.right[j].sum()
        if not self.same:
            self.n[j + self.shift] += self.left[i].sum()
        both = np.concatenate([i, j + self.shift])
        self.labels = forest(self.labels, both[1:], np.full(len(both) - 1, both[0]))

    def add_matrix(self, i: np.ndarray, j: np.ndarray, linked: np.ndarray) -> None:
        row = np.flatnonzero(linked.any(1))
        if not row.size:
            return
        self.n[i[row]] += linked[row] @ self.right[j]
        if not self.same:
            self.n[j + self.shift] += self.left[i[row]] @ linked[row]
        # each row with its first partner, each column with its first row, and rows joined through shared columns
        a, b = [i[row]], [j[linked[row].argmax(1)] + self.shift]
        col = np.flatnonzero(linked.any(0))
        a.append(i[linked[:, col].argmax(0)])
        b.append(j[col] + self.shift)
        left = forest(self.labels, np.concatenate(a), np.concatenate(b))
        apart = left[i[row]][:, None] != left[j + self.shift][None, :]
        if (rest := np.argwhere(linked[row] & apart)).size:
            left = forest(left, i[row[rest[:, 0]]], j[rest[:, 1]] + self.shift)
        self.labels = left


def traverse(left: Side, right: Side, least: float, same: bool) -> Links:
    """Links (cosine >= least) between two blocks, or within one; there each ordered pair counts once and none with itself."""
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    found = Links(left.weight, right.weight, same)
    # leaves of one point meet through their centres at once: in single precision with a margin first, what is left in double
    across = right.single_precision[right.centres[right.single]].T
    for a in range(0, left.single.size, 1024):
        own = left.single[a : a + 1024]
        i, j = np.nonzero(left.single_precision[left.centres[own]] @ across >= least - 1e-4)
        i, j = left.centres[own][i], right.centres[right.single][j]
        keep = (i != j) | (not same)
        keep[keep] = np.einsum("ij,ij->i", left.points[i[keep]], right.points[j[keep]]) >= least
        if keep.any():
            found.add(i[keep], j[keep])
    pairs = [(left.many, np.arange(len(right.centres))), (left.single, right.many)]
    for rows, cols in pairs:
        for a in range(0, rows.size, 1024):
            own = rows[a : a + 1024]
            cos = left.points[left.centres[own]] @ right.points[right.centres[cols]].T
            reach = left.radius[own][:, None] + right.radius[cols][None, :] + eps + SLACK
            for x, y in np.argwhere(cos >= 1 - np.minimum(reach, 2) ** 2 / 2):
                _expand(left, right, left.members[own[x]], right.members[cols[y]], least, eps, found, 1)
    return found


def _expand(left: Side, right: Side, i: np.ndarray, j: np.ndarray, least: float, eps: float, found: Links, depth: int) -> None:
    """Point sets of two nodes: through their finer nodes where there are enough points, else point by point."""
    if depth < len(RADII) and len(i) * len(j) > 4096:
        ci, ni = np.unique(left.nets[depth][i], return_inverse=True)
        cj, nj = np.unique(right.nets[depth][j], return_inverse=True)
        if len(ci) * len(cj) * 4 < len(i) * len(j):
            mi, mj = [i[ni == k] for k in range(len(ci))], [j[nj == k] for k in range(len(cj))]
            far = lambda s, m, c: max(0.0, math.sqrt(max(0.0, 2 - 2 * float((s.points[m] @ s.points[c]).min()))))
            ri = np.array([far(left, m, c) for m, c in zip(mi, ci)])
            rj = np.array([far(right, m, c) for m, c in zip(mj, cj)])
            dist = np.sqrt(np.maximum(0, 2 - 2 * (left.points[ci] @ right.points[cj].T)))
            reach = ri[:, None] + rj[None, :]
            for x, y in np.argwhere(dist <= reach + eps + SLACK):
                if dist[x, y] + reach[x, y] < eps - SLACK and not (found.same and ci[x] == cj[y]):
                    found.add_all(mi[x], mj[y])
                else:
                    _expand(left, right, mi[x], mj[y], least, eps, found, depth + 1)
            return
    for a in range(0, len(i), 1024):
        own = i[a : a + 1024]
        linked = left.points[own] @ right.points[j].T >= least
        if found.same:
            linked &= own[:, None] != j[None, :]
        if linked.any():
            found.add_matrix(own, j, linked)


def _points(units) -> np.ndarray:
    rows = units.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _split(radius: float):
    """A sample of a cell's points -> the cell's centres, one after the other in a binary."""

    def run(sample: pa.Table) -> pa.Table:
        units = sample.sort_by("rep").column("unit").to_pylist()[: 4 * SAMPLE]
        points = np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)
        return pa.table({"of": sample.column("cell")[:1], "centres": pa.array([points[farthest_first(points, FAN, radius)].tobytes()], pa.binary())})

    return run


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of split cells -> the number, centre and distance of the nearest child; others keep what they have."""
    for b in batches:
        child, centre, far = [0] * b.num_rows, b.column("centre").to_pylist(), b.column("far").to_pylist()
        raw = b.column("centres").to_pylist()
        by: dict[bytes, list[int]] = {}
        for k, c in enumerate(raw):
            if c is not None:
                by.setdefault(c, []).append(k)
        for c, rows in by.items():
            x = _points(b.column("unit").take(pa.array(rows)))
            cos = x @ np.frombuffer(c, "<f8").reshape(-1, x.shape[1]).T
            best = cos.argmax(1)
            for k, m, v in zip(rows, best.tolist(), cos.max(1).tolist()):
                child[k], centre[k], far[k] = m + 1, c[m * 8 * x.shape[1] : (m + 1) * 8 * x.shape[1]], math.sqrt(max(0.0, 2 - 2 * v))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("rep", "m", "unit", "cell")), pa.array(child, pa.int64()), pa.array(centre, pa.binary()), pa.array(far, pa.float64())], ["rep", "m", "unit", "up", "child", "centre", "far"])


def tree(points: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """points (rep, m, unit) with their cell, a leaf; and the nodes (up, node, r, centre) of each level from the roots down."""
    # vectors of a length are a tree of their own: its root holds them all, without a centre
    placed = materialize(points.select("rep", "m", "unit", F.length("unit").cast("long").alias("cell"), F.lit(None).cast("binary").alias("centre"), F.lit(2.0).alias("far")))
    nodes: list[DataFrame] = []
    while len(nodes) < LEVELS:
        # cells that points of one place fill are not split
        big = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).where((F.col("n") > block) & (F.col("r") > 1e-6))
        big = materialize(big.select(F.col("cell").alias("of"), "n"))
        if not big.take(1):
            break
        chance = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = placed.join(big, F.col("cell") == F.col("of")).where(chance < F.lit(float(SAMPLE)) / F.col("n")).select("cell", "rep", "unit")
        centres = materialize(sample.groupBy("cell").applyInArrow(_split(2.0 ** -len(nodes)), "of long, centres binary"))
        dealt = placed.join(centres, F.col("cell") == F.col("of"), "left").select("rep", "m", "unit", "cell", "centre", "far", "centres")
        dealt = dealt.mapInArrow(_assign, "rep long, m long, unit binary, up long, child long, centre binary, far double")
        cell = F.when(F.col("child") > 0, F.xxhash64("up", "child")).otherwise(F.col("up"))
        placed = materialize(dealt.select("rep", "m", "unit", "up", cell.alias("cell"), "centre", "far"))
        nodes.append(materialize(placed.groupBy("up", F.col("cell").alias("node")).agg(F.max("far").alias("r"), F.max("centre").alias("centre"))))
    return placed.select("rep", "m", "unit", "cell"), nodes


def _reach(eps: float):
    """Pairs of nodes that may hold a link: centres within both radii and the threshold; a root has no centre and meets all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (x, y, r) in enumerate(zip(b.column("ca").to_pylist(), b.column("cb").to_pylist(), b.column("reach").to_pylist())):
                if x is None or y is None:
                    keep.append(k)
                else:
                    d = np.frombuffer(x, "<f8") - np.frombuffer(y, "<f8")
                    if math.sqrt(float(d @ d)) <= r + eps + SLACK:
                        keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return run


def cell_pairs(placed: DataFrame, nodes: list[DataFrame], least: float) -> DataFrame:
    """(a, b), a <= b: the pairs of leaves that survive the pruning from the roots down."""
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    root = nodes[0].select(F.col("up").alias("a")) if nodes else placed.select(F.col("cell").alias("a"))
    pairs = root.distinct().withColumn("b", F.col("a"))
    for node in nodes:
        side = lambda k: node.select(F.col("up").alias(f"u{k}"), F.col("node").alias(f"n{k}"), F.col("r").alias(f"r{k}"), F.col("centre").alias(f"c{k}"))  # noqa: B023, E731
        both = pairs.join(side("a"), F.col("a") == F.col("ua")).join(side("b"), F.col("b") == F.col("ub")).where("a <> b or na <= nb")
        both = both.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "ca", "cb", (F.col("ra") + F.col("rb")).alias("reach"))
        pairs = materialize(both.mapInArrow(_reach(eps), "a long, b long"))
    return pairs


_NODES = "rep long, m long, unit binary, cell long, gid long, nets array<int>"


def _build(block: pa.Table) -> pa.Table:
    block = block.sort_by("rep")
    nets = levels(_points(block.column("unit")))
    return pa.table({k: block.column(k) for k in ("rep", "m", "unit", "cell", "gid")} | {"nets": pa.array(list(nets.T.astype(np.int32)), pa.list_(pa.int32()))})


def _meet(least: float):
    def run(key, pair):
        a, b = (k.as_py() for k in key)
        # the lower block first
        pair = pair.sort_by([("gid", "ascending"), ("rep", "ascending")])
        gid, ids, weight = (pair.column(k).to_numpy() for k in ("gid", "rep", "m"))
        cut = int(np.searchsorted(gid, a, "right"))
        points = _points(pair.column("unit"))
        nets = pair.column("nets").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).T.astype(np.int64)
        left = Side(points[:cut], nets[:, :cut], weight[:cut])
        found = traverse(left, left if a == b else Side(points[cut:], nets[:, cut:], weight[cut:]), least, a == b)
        at = np.flatnonzero(found.n)
        return pa.table({"rep": pa.array(ids[at]), "n": pa.array(found.n[at]), "root": pa.array(ids[found.labels[at]])})

    return run


def links(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    rows = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = scaled(b.column("v"))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at)), pa.array(out, pa.binary())], ["row", "unit"])

    units = materialize(rows.where("v is not null").select("row", "v").mapInArrow(unit, "row long, unit binary").withColumn("same", F.sha2("unit", 256)))
    first = materialize(units.groupBy("same").agg(F.min("row").alias("rep"), F.count("*").alias("m")))
    placed, nodes = tree(units.join(first, F.col("row") == F.col("rep")).select("rep", "m", "unit"), block)
    pairs = cell_pairs(placed, nodes, least)
    # leaves in blocks: nearly always one
    leaves = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).select(F.col("cell").alias("of"), "blocks"))
    gid = lambda cell, k: F.xxhash64(cell, k)
    dealt = placed.join(leaves, F.col("cell") == F.col("of")).select("rep", "m", "unit", "cell", gid("cell", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).alias("gid"))
    built = materialize(dealt.groupBy("gid").applyInArrow(_build, _NODES))
    met = pairs.select(F.col("a").alias("own"), F.col("b").alias("other")).union(pairs.where("a <> b").select("b", "a"))
    met = met.join(leaves, F.col("other") == F.col("of")).select("own", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: gid(F.col("other"), k))).alias("with"))
    sent = built.join(met, F.col("cell") == F.col("own")).select(F.least("gid", "with").alias("p"), F.greatest("gid", "with").alias("q"), "rep", "m", "unit", "gid", "nets")
    found = materialize(sent.groupBy("p", "q").applyInArrow(_meet(least), "rep long, n long, root long"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of = units.select("row", "same").join(first, "same").select("row", "rep", "m").join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = rows.select("row", "vec_id").join(of.select("row", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("comp")), "row", "left")
    of = of.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "row").alias("comp"))
    named = of.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    return of.join(named, "comp").select("vec_id", "n_links", "component_id")


def op10(spark, sf_dir: str) -> DataFrame:
    done = links(table(spark, sf_dir, "embeddings"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
