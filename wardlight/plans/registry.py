"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlight.sources.adapters import DUCK_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def with_inputs(inputs: str, body: str, /, **ctes: str) -> str:
    """``body`` preceded by the adapters in ``inputs`` and any extra CTEs."""
    parts = [f"{n} AS ({DUCK_SQL[n]})" for n in inputs.split()]
    parts += [f"{n} AS ({text})" for n, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
