"""Name -> Spark plan and the plain SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, folder) -> DataFrame`; `sql` is its check query where one exists."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(value, digits: int = 6) -> Column:
    """Rounded double; adding zero turns -0.0 into 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def R(expression: str, digits: int = 6) -> str:
    """SQL twin of `r`."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0e0)"


def row_text(*expressions: str) -> str:
    """SQL twin of the text that `row_digest` hashes."""
    return "concat(" + ", ".join(f"coalesce(concat(length(CAST({e} AS VARCHAR)), ':', CAST({e} AS VARCHAR)), '-')" for e in expressions) + ")"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
