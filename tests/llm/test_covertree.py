import numpy as np
import pytest

from bookflow.llm import covertree as C


def brute(vectors, least=0.95):
    """{id: (links, component)} by comparing every pair."""
    ids = sorted(vectors)
    ok = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    up, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if i in ok and j in ok and ok[i].size == ok[j].size and ok[i] @ ok[j] / (np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (n[i], top(i)) for i in ids}


def made(n, d, seed, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(2, n // 12), d))
    out = centres[(rng.random(n) ** 3 * len(centres)).astype(int)] + spread * rng.standard_normal((n, d)) * rng.choice([0, 0.3, 1, 3, 9], (n, 1))
    return {k: (3 * x).tolist() for k, x in enumerate(out)}


@pytest.mark.parametrize("d", [2, 3, 8, 64])
def test_traversal_equals_all_pairs(d):
    points = np.array(list(made(900, d, d).values()))
    points /= np.linalg.norm(points, axis=1)[:, None]
    nets = C.levels(points)
    for net, radius in zip(nets, C.RADII):
        big = np.bincount(nets[0], minlength=900)[nets[0]] > 32 if radius < C.RADII[0] else np.ones(900, bool)
        assert radius < C.RADII[0] or (np.einsum("ij,ij->i", points, points[net])[big] >= 1 - radius**2 / 2 - 1e-12).all()
    m = np.random.default_rng(d).integers(1, 4, 900)
    whole = C.traverse(*[C.Side(points, nets, m)] * 2, 0.95, True)
    linked = points @ points.T >= 0.95
    np.fill_diagonal(linked, False)
    assert (whole.n == linked @ m).all()
    halves = [C.Side(p, C.levels(p), w) for p, w in ((points[:400], m[:400]), (points[400:], m[400:]))]
    between = C.traverse(*halves, 0.95, False)
    assert (between.n == np.concatenate([linked[:400, 400:] @ m[400:], linked[400:, :400] @ m[:400]])).all()
    for found, m in ((whole, linked), (between, linked & np.not_equal.outer(np.arange(900) < 400, np.arange(900) < 400))):
        reach = m | np.eye(900, dtype=bool)
        while True:
            more = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
            if (more == reach).all():
                break
            reach = more
        assert ((found.labels[:, None] == found.labels[None, :]) == reach).all()


def rows_of(got):
    return sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id) for r in got))


def wanted(ids, vectors):
    """By brute force over rows: ids may be null or repeat."""
    found = brute(dict(enumerate(vectors)))
    least = {}
    for k, (_, c) in found.items():
        if ids[k] is not None:
            least[c] = min(ids[k], least.get(c, ids[k]))
    return sorted((ids[k] is None, ids[k] or 0, n, least.get(c, -1)) for k, (n, c) in found.items())


def test_odd_vectors_against_brute_force(spark):
    vectors = made(500, 6, 1) | {600: None, 601: [], 602: [0.0] * 6, 603: [1.0, None, 0, 0, 0, 0], 604: [float("nan")] * 6, 605: [float("inf"), 1, 0, 0, 0, 0], 606: [1e300] * 6, 607: [1e-300] * 6, 608: [1.0, 2.0], 609: [2.0, 4.0], 610: [1.0], 611: [-1.0]}
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in vectors.items()]
    rows += rows[:5] + [(3, rows[9][1], 1, "x"), (None, [1.0] * 6, 1, "x"), (None, rows[7][1], 1, "x"), (None, [0.0, 0.0, 0.0, 0.0, -1.0, 0.0], 1, "x"), (None, None, 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string")
    plain = [[1.0] * 6 if r[0] in (606, 607) else r[1] for r in rows]
    for block in (8192, 20):
        assert rows_of(C.links(frame, block=block).collect()) == wanted([r[0] for r in rows], plain)
    assert C.links(frame.limit(0)).count() == 0


def test_several_levels_prune_cells(spark):
    """Points in a plane: cells split five times; most pairs of leaves are pruned before any vector is sent, and no link is lost."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    turn = np.concatenate([r.uniform(0, 2 * np.pi, 1500), r.normal(1.0, 0.001, 900), np.full(300, 2.0)])
    points = [[float(np.cos(x)), float(np.sin(x))] for x in turn]
    frame = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    units = frame.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("m"), "embedding")

    def unit(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("m"), pa.array(C.scaled(b.column("embedding"))[1], pa.binary())], ["rep", "m", "unit"])

    placed, nodes = C.tree(units.mapInArrow(unit, "rep long, m long, unit binary"), block=24)
    assert len(nodes) >= 5
    leaves, kept = placed.select("cell").distinct().count(), C.cell_pairs(placed, nodes, 0.9999).count()
    print(f"{leaves} leaves, {kept} of {leaves * (leaves + 1) // 2} pairs compared")
    assert kept < leaves * (leaves + 1) // 2 / 4
    assert rows_of(C.links(frame, least=0.9999, block=24).collect()) == sorted((False, k, n, c) for k, (n, c) in brute(dict(enumerate(points)), 0.9999).items())


def test_long_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((6, 20_000))
    points = np.concatenate([base, base[:3] + 0.1 * r.standard_normal((3, 20_000))])
    got = C.links(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(points)], "vec_id long, embedding array<double>")).collect()
    assert [(x.n_links, x.component_id) for x in sorted(got)] == [(1, 0), (1, 1), (1, 2), (0, 3), (0, 4), (0, 5), (1, 0), (1, 1), (1, 2)]


def test_query_on_embeddings(spark, sf):
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = C.op10(spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
