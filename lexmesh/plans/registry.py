"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql``
    is the equivalent DuckDB query (omitted for non-SQL operators)."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracle_texts() -> dict[str, str]:
    """The oracle SQL of every query that has one, built on request."""
    return {k: v() if callable(v) else v for k, v in ORACLE.items()}


def oracle(name: str) -> Callable[[], str]:
    """The oracle SQL of another query, for one with the same result by another way."""
    def text() -> str:
        sql = ORACLE[name]
        return sql() if callable(sql) else sql
    return text
