"""All named queries of the library with their comparison SQL."""

from . import customers, logs, products, sales, scalars, storage, streams, warehouse  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
