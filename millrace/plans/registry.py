"""All registered queries of the library proper, name to callable, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin if there is one."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every module that registers queries."""
    import importlib

    for m in MODULES:
        importlib.import_module(f"millrace.plans.{m}")
    return dict(QUERIES), dict(SQL)


MODULES: list[str] = ["relational", "scalar", "vectors", "state", "layouts", "placing", "grids", "hierarchy", "ingest", "files"]
