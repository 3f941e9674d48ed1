"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    """Register a query under its function name, with the SQL to compare it with, if any."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def load() -> None:
    for module in ("datapoints", "entities", "schemas", "catalogs", "tables", "files", "streams", "versions"):
        importlib.import_module(f"dimlens.workload.{module}")
