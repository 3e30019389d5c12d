"""Every query of the engine with its SQL, gathered from the modules of this folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("splits", "metrics", "planning", "tiling", "bags", "rows", "sampling", "jobs", "rasters", "pixels", "catalogue", "flows", "training", "library")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory id, with DuckDB SQL that gives the same rows."""

    def put(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return put


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tesserae.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified patient split with its per-class table."""
    _load()
    return _QUERIES["agg_10_split_descriptor"](spark, sf_dir)
