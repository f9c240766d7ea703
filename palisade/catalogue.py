"""Every query of the engine by name, with SQL for an independent check where SQL expresses it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "fusion_all"
PLANS = ("robust", "sequence", "tiles", "files", "branches", "pixels", "fusion", "localize", "stability", "evaluate", "project")
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, and SQL that gives the same rows."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def written(name: str) -> str:
    """The SQL that a query has been registered with, for queries that build on it."""
    return _SQL[name]


def _load() -> None:
    for name in PLANS:
        importlib.import_module(f"palisade.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
