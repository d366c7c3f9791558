"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its name, with the SQL over tables of the same names if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def build(name: str) -> Query:
    """The query of this name; an unknown one is an error that tells the known."""
    if name not in QUERIES:
        raise KeyError(f"unknown query {name!r}; known: {', '.join(sorted(QUERIES))}")
    return QUERIES[name]
