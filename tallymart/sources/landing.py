"""Streams landed in dated chunks, each batch once, with small files put together."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .store import Store

ROWS, DAY = "rows", "event_date"
COMPACT_AFTER, KEEP_VERSIONS = 8, 16


def by_date(df: DataFrame, day: Column, by: str = "day") -> DataFrame:
    """The frame with the date that a row is stored under: its day, or the first one of its month."""
    if by not in ("day", "month"):
        raise ValueError("by must be day or month")
    return df.withColumn(DAY, day if by == "day" else F.trunc(day, "month"))


def land_batch(batch: DataFrame, batch_id: int, root: str, query: str, by: str = "day", compact_after: int = COMPACT_AFTER) -> bool:
    """Add a micro-batch made by ``by_date`` to the store; False if it is there already.

    Which batch of which query came last is published with the rows, so a batch that is
    handed out again after a failure adds nothing.  A day in more than ``compact_after``
    folders is put into one; readers that have begun keep the old folders for a while.
    """
    store = Store(batch.sparkSession, root)
    compacted: list[str] = []
    with store.transaction() as change:
        if batch_id <= change.notes.get(query, -1):
            return False
        change.append(ROWS, batch, DAY)
        change.notes[query] = batch_id
        change.notes["by"] = by
        compacted = change.compact(ROWS, compact_after)
    if compacted:
        store.vacuum(keep=KEEP_VERSIONS)
    return True


def land_stream(
    df: DataFrame,
    lake: str,
    name: str,
    checkpoints: str | None = None,
    available_now: bool = False,
    trigger: str = "1 minute",
    day: Column | None = None,
    by: str = "day",
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Append a stream to ``<lake>/<name>``, by day.

    ``day`` is the date that a row belongs to, by default that of its window's start; rows
    without one have a chunk of their own.  Small streams take ``by="month"``.  The query
    is named by its target.
    """
    lake = lake.rstrip("/")
    root = f"{lake}/{name}"
    rows = by_date(df, F.to_date("window.start") if day is None else day, by)

    def add(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        land_batch(batch, batch_id, root, query, by, compact_after)

    writer = (
        rows.writeStream.outputMode("append")
        .foreachBatch(add)
        .option("checkpointLocation", f"{(checkpoints or lake + '/checkpoints').rstrip('/')}/{name}")
        .queryName(re.sub(r"\W+", "_", root).strip("_"))
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def is_landed(spark: SparkSession, lake: str, name: str) -> bool:
    return Store(spark, f"{lake.rstrip('/')}/{name}").version() > 0


def read_landed(spark: SparkSession, lake: str, name: str, start=None, end=None) -> DataFrame:
    """Landed rows of the days, or months, from that of ``start`` to before ``end``; others are not read."""
    store = Store(spark, f"{lake.rstrip('/')}/{name}")
    rows = store.read(ROWS)
    if start is not None:
        first = F.lit(start).cast("date")
        rows = rows.where(F.col(DAY) >= (first if store.manifest()["notes"].get("by", "day") == "day" else F.trunc(first, "month")))
    if end is not None:
        rows = rows.where(F.col(DAY) < F.lit(end).cast("date"))
    return rows
