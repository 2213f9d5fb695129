"""Registry of named queries and their DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures.views import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# White space removed by `strip`, as a DuckDB expression.
WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31))"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its check, fixture views are added to it."""

    def add(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
