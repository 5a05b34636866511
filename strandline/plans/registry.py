"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from strandline.plans.fixtures import duckdb_with, view

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, ctes: str = "") -> Callable:
    """Register fn(*views) as a query. sql follows the views' WITH clause; ctes adds more common table expressions."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLE_SQL[name] = duckdb_with(*views) + (",\n" + ctes.strip() if ctes else "") + "\n" + sql.strip()
        return fn

    return add
