"""Queries and their SQL, side by side: @query(sql) registers a function (spark, sf_dir) under its name.

The SQL is registered as a materialized table expression: DuckDB 1.x can wait forever on a LIMIT around a query whose
last step joins a table expression with itself, and a caller may add one.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with answer as materialized ({sql}) select * from answer"
        return f

    return add


def load() -> None:
    for name in ("q_layout", "q_text", "q_outliers", "q_elements", "q_results", "q_colons"):
        importlib.import_module(f"folioscan.plans.{name}")
