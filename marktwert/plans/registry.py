"""Named query registry: each entry binds an operator to the driver tables.

``register(key, sql=...)`` records a callable ``(spark, sf_dir) -> DataFrame``
and, when the operator is SQL-expressible, the DuckDB oracle text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import market_queries, stats_queries, usage_queries, io_queries  # noqa: F401
    from . import model_queries, stream_queries  # noqa: F401
