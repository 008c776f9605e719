"""Queries with DuckDB SQL against it, on whole tables."""

import os

import duckdb
import pytest

from linkloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = lambda x: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x)
    assert rows(found.select(*columns).collect()) == rows(want.project(", ".join(columns)).fetchall())
