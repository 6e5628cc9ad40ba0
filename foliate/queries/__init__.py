"""Named queries: each a Spark plan over the given tables and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def load() -> dict[str, tuple[Query, str | None]]:
    from . import blocks, elements, emphasis, joins, layout, lines, maths, normal, ordered, relations, rules, sources, verbatim, versions  # noqa: F401

    return REGISTRY
