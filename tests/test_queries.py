"""Registered queries against their SQL on small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# without rows on the smallest tables
SPARSE = {"a4_evidence_overlap"}
OWN = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF)
    rows = found.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows or found.columns
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(found.columns) == sorted(columns)
    assert len(rows) == len(expected)
    assert normal(found.columns, rows) == normal(columns, expected)
    assert rows or name in SPARSE, "an empty result proves nothing"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
