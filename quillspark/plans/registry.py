"""Registration of queries: a Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its oracle."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
