"""Argument checks that need no job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require(df: DataFrame, *columns: str) -> None:
    """Raise ValueError where a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
