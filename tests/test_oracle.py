"""Every query with SQL gives DuckDB's rows; the others give rows."""

from __future__ import annotations

import duckdb
import pytest

from kerbside.plans import catalog
from kerbside.plans.views import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    assert sorted(df.columns) == sorted(c[0] for c in got.description)
    assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
