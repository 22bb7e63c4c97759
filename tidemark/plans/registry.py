"""All queries of the library and their DuckDB SQL.

A query module registers functions (spark, sf_dir) -> DataFrame under the operator's
name, with the SQL that a second engine runs on the same tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("technical", "metrics", "screening", "portfolio", "text", "decision", "evaluation", "store", "forecasting", "significance", "rules", "steps", "files", "streams", "feeds", "turns")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered already")
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemark.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_01_performance"](spark, sf_dir)
