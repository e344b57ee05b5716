"""Registered queries: each key maps to a Spark plan and (mostly) a DuckDB oracle.

A query callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole landed tables. The oracle SQL builds the same adapter views in
DuckDB (``oracle_views``) and computes the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basketry.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register a query under ``key`` with optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(fn, with_views(sql) if sql else None)
        return fn
    return deco


def _load_all() -> None:
    # importing the plan modules fills REGISTRY
    from basketry.plans import (order_plans, customer_plans, product_plans,  # noqa: F401
                                source_plans, ml_plans)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql}
