"""Name -> query registry.

Each registered query is a callable ``(spark, sf_dir) -> DataFrame`` that reads
the driver tables (or tables Spark derives from them). ``sql`` is the
independent DuckDB oracle over the same parquet views; ``None`` marks an
operator checked rows-only plus unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH a AS (...), b AS (...) body``."""
    if not ctes:
        return body
    parts = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"


def load_all() -> None:
    # importing registers the queries
    from . import (  # noqa: F401
        q_metrics, q_scalar, q_splits, q_tokens, q_joins, q_aggs, q_graph,
        q_molecules, q_sources, q_streaming, q_ml,
    )
