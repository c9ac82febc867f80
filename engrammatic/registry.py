"""Named queries over the test tables, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engrammatic.tables import expand

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under this name; the SQL may name derived tables (see tables.py)."""

    def add(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = expand(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from engrammatic import plans

    plans.load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL
