"""Every query with SQL gives the same rows in DuckDB; every other one runs."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.registry.QUERIES, entry.registry.ORACLE_SQL


@pytest.fixture(scope="module")
def sf_dir():
    return os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 6)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in found.collect()]
    assert len(set(found.columns)) == len(found.columns)
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    expected = rows(columns, cursor.fetchall())
    actual = rows(found.columns, got)
    assert len(actual) == len(expected)
    wrong = [(a, e) for a, e in zip(actual, expected, strict=True) if a != e]
    assert not wrong, wrong[:2]
