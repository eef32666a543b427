"""Every query against its SQL on the same tables; those without SQL run and are held against brute force elsewhere."""

import math
import os

import duckdb
import pytest

from bookflow import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, abs_tol=2e-6, rel_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not bad, (cols, bad[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
