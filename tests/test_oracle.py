"""Every registered query against its SQL counterpart in DuckDB, on the same Parquet files."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = entry.queries()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}  # those have tests of their own


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(value):
    """A value as both engines write it."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, duck, name):
    found = QUERIES[name](spark, tiny)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    answer = duck.execute(SQL[name])
    want = rows([c[0] for c in answer.description], answer.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not odd, odd[:3]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
