"""Registry of named queries: Spark plan + optional DuckDB oracle text.

Each Spark plan is a callable ``(spark, sf_dir) -> DataFrame``. The oracle
is ANSI SQL over the driver's base tables; the fx views it uses are inlined
as CTEs by ``oracle_with`` so DuckDB needs nothing pre-registered beyond
the base tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import oracle_with


@dataclass
class Query:
    name: str
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle_with(sql) if sql else None, note)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills REGISTRY
    from . import audit, diff, extract, monitor, schema, scripts, transfer  # noqa: F401
    return REGISTRY
