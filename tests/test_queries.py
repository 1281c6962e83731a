"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import registry

QUERIES, SQL = registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    return c


def plain(rows):
    return sorted([tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r))[c] for c in columns) for r in rel.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "denormalized_export" in __spark_entry__.queries()
