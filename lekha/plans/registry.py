"""All queries by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    """Import the modules that register their queries."""
    for name in ("text", "corpus", "records", "scores", "statistics", "shapes", "extract", "reports", "stages"):
        try:
            importlib.import_module(f"lekha.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"lekha.plans.{name}":
                raise


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
