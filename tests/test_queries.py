"""Every driver query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in cols]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in got.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
