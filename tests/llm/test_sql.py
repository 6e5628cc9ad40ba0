"""Queries of the subpackage that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from foliate.llm import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    answer = con.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    want = sorted(answer.fetchall(), key=repr)
    found = Q.queries()[name](spark, small)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == want
