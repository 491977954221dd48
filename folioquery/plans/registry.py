"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
MODULES = ("retrieval", "ledger", "ingest", "relational", "notifications", "facts", "answers", "names", "scalars", "evaluation", "routing", "streams", "maintenance", "requests", "vocabulary")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql: what DuckDB runs on the same tables."""

    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"folioquery.plans.queries_{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
