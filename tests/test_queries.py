"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sparkweave.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def same(x):
    return round(x, 7) if isinstance(x, float) else x


def check(spark, duck, name, query, sql):
    got = query(spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    found = [tuple(same(v) for v in r) for r in got.select(*columns).collect()]
    assert sorted(found, key=repr) == sorted((tuple(same(v) for v in r) for r in want), key=repr), name


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_graph_query(spark, duck, name):
    check(spark, duck, name, QUERIES[name], ORACLE[name])


def test_every_graph_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "dist"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
