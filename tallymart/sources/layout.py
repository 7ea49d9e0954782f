"""File layouts that let readers skip most files of a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .writers import with_chunk


def interleaved(df: DataFrame, columns: list[str], name: str, bits: int = 5) -> DataFrame:
    """The frame with a number whose bits are taken in turn from the columns' places among their own quantiles.

    Rows near each other in this order are near in every column at once.  The edges come
    from one pass with sketches, ``2 ** bits - 1`` values a column, and go through the
    driver; a null is in the lowest place.
    """
    probs = [i / 2**bits for i in range(1, 2**bits)]
    edges = df.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in columns]).first()
    zero = F.lit(0).cast("long")
    places = {
        f"{name}_{k}": sum(((F.col(c) > F.lit(e)).cast("long") for e in sorted(set(edges[c] or []))), zero) for k, c in enumerate(columns)
    }
    placed = df.withColumns({n: F.coalesce(p, zero) for n, p in places.items()})
    out = zero
    for b in range(bits):
        for k, n in enumerate(places):
            out = out + F.shiftleft(F.shiftright(n, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + k)
    return placed.withColumn(name, out).drop(*places)


def write_clustered(
    df: DataFrame, path: str, columns: list[str], column: str = "order_date", chunk: str = "month", files: int = 64, mode: str = "overwrite"
) -> None:
    """Store by time, each chunk's files in the interleaved order of some columns.

    A filter on one of the columns then meets few files by their smallest and largest
    values; where many values are left, a Bloom filter in each file tells whether a single
    one is there.  ``files`` is about how many files are written in all.
    """
    rows, part = with_chunk(df, column, chunk)
    writer = interleaved(rows, columns, "_z").repartitionByRange(files, part, "_z").sortWithinPartitions(part, "_z").drop("_z").write.mode(mode)
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
