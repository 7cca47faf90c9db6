"""Every query with SQL gives what DuckDB gives; every other one has rows and a stable schema."""

import datetime
import decimal

import duckdb
import pytest

from lexloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = df.collect()
    if name not in registry.oracle_sql():
        assert got and df.columns
        return
    rel = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    expected = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rel.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr) == sorted(expected, key=repr)
