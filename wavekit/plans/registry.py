"""Registry of named queries (Spark callables) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, data_dir) -> DataFrame`` under ``key``; ``sql`` is its DuckDB twin (None = rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that its registrations run."""
    from wavekit.plans import (  # noqa: F401
        q_recode,
        q_profile,
        q_models,
        q_eval,
        q_rank,
        q_split,
        q_corr,
        q_sources,
        q_attr,
        q_ml,
    )
