"""Named queries over the driver's test tables, with their DuckDB oracle SQL.

Every query reads the parquet tables (through the fixture views in
``sources.fixtures``) in full, so its work grows with the data. Parameters
such as an upload id or a page are the feature being exercised, stated as
literals in the query and in its SQL.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

MODULES = ["queries_sales", "queries_cleaning", "queries_profile", "queries_validation",
           "queries_files", "queries_insights", "queries_tables"]


def query(name: str, sql: str | None = None):
    """Register a query (and its oracle SQL, when SQL can state it)."""
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def load() -> None:
    """Import the query modules; each registers its queries on import."""
    for m in MODULES:
        importlib.import_module(f"ledgerloom.plans.{m}")


def queries() -> dict[str, QueryFn]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLE)
