"""Registry of named queries: a frame builder and, where SQL can say it, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..staging import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}

# Reference moments and whole-table ranges of the given data.
AS_OF = "2001-08-02"
START, END = "1995-01-01", "2001-12-31"
LOG_AS_OF = "2024-01-31"
LOG_START, LOG_END = "2024-01-01", "2024-01-31"


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round figures whose last bits depend on the order of summing."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
