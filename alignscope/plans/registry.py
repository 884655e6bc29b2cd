"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ints: str = "") -> Callable[[Query], Query]:
    """Register a query, with the DuckDB SQL of the same rows where there is one; ``ints`` are its 32-bit columns."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            casts = ", ".join(f"cast({c} as int) as {c}" for c in ints.split())
            _SQL[name] = f"select * replace ({casts}) from ({sql})" if casts else sql
        return f

    return add


def oracle(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def _load() -> None:
    from . import alignment, columns, files, filters, sets, space, summary, vocabulary  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["core_best_label"](spark, sf_dir)
