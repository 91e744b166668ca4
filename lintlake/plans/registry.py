"""Catalogue of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def sq(text: str) -> str:
    """Quote a string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sq(i) for i in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join(sq(i) for i in items) + ")"


def sql_values(rows) -> str:
    """``VALUES`` rows from tuples of str / int / float / bool."""

    def one(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return "NULL" if v is None else sq(v)

    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
