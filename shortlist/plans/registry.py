"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its twin."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def also(name: str, f: Callable) -> None:
    """Register a query and its twin under an earlier name."""
    QUERIES[name] = f
    if f.__name__ in SQL:
        SQL[name] = SQL[f.__name__]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded; for comparing engines whose sums differ in the last bits."""
    return df.select(*[r6(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def r6(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def text(c: str | Column) -> Column:
    """An array as text."""
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), ",")
