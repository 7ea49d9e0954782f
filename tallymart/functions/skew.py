"""Joins that stay balanced when one key holds very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_on_key(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows that may repeat a key very often with one row per key.

    Spark splits a hot key at run time only where both sides come straight
    from a shuffle.  A side that was already grouped or joined by the key
    does not, as it would be used in place.  The second join key makes Spark
    shuffle that side, the smaller one, once more.
    """
    spread = F.xxhash64(key)
    return (
        many.withColumn("_spread", spread)
        .join(one.withColumn("_spread", spread), [key, "_spread"], how)
        .drop("_spread")
    )
