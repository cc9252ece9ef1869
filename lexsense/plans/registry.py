"""Registry of named queries (Spark callable + DuckDB oracle SQL) exposed by ``__spark_entry__``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL (if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Results are compared at 6 decimals. Rational scores such as 13/128 sit exactly on a rounding
# tie, where last-bit differences between engines would flip the result; a 1e-12 nudge (far above
# double noise for values up to ~1e3, far below the 6th decimal) moves the tie off such values.
NUDGE = 1e-12


def r6(c) -> Column:
    """Round a double to 6 places and fold -0.0 into 0.0 (mirrors ``oracle.r6``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
