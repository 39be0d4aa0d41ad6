"""Named queries: a Spark function and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("claims", "matching", "evidence", "verdicts", "serving", "metrics", "streams", "storage", "endtoend")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equivalent statement for the second engine."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        try:
            import_module(f"{__package__}.{module}")
        except ModuleNotFoundError as error:
            if error.name != f"{__package__}.{module}":
                raise


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
