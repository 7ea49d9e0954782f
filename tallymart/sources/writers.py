"""Batch and streaming sinks, upserts, refresh and retention."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import stored


def to_messages(df: DataFrame) -> DataFrame:
    """Each row as one JSON message."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def publish_json(df: DataFrame, topic: str, target: str = "kafka", path: str | None = None, **options: str) -> None:
    """Write rows as JSON messages to a Kafka topic, or to text files below ``path``."""
    messages = to_messages(df)
    if target == "kafka":
        messages.write.format("kafka").option("topic", topic).options(**options).save()
    else:
        messages.write.mode("append").format(target).options(**options).save(f"{path.rstrip('/')}/{topic}")


def lake_stream_sink(
    df: DataFrame,
    lake: str,
    name: str,
    checkpoints: str | None = None,
    available_now: bool = False,
    trigger: str = "1 minute",
) -> StreamingQuery:
    """Append a stream to ``<lake>/<name>`` with its own checkpoint.

    The query is named by its target, so jobs and raw landing run side by side.
    """
    lake = lake.rstrip("/")
    checkpoint = f"{(checkpoints or lake + '/checkpoints').rstrip('/')}/{name}"
    writer = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{lake}/{name}")
        .option("checkpointLocation", checkpoint)
        .queryName(re.sub(r"\W+", "_", f"{lake}/{name}").strip("_"))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


# A stored chunk of a time-partitioned table, and the step to the next one.
CHUNKS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def by_time(df: DataFrame, column: str) -> DataFrame:
    """Rows of one chunk sit together, so a chunk is few files.

    The rebalance hint lets Spark split a chunk that holds most of the rows.
    """
    return df.hint("rebalance", column)


def with_chunk(df: DataFrame, column: str, chunk: str) -> tuple[DataFrame, str]:
    """The frame and the column it is partitioned by: the date itself, or the
    first date of its week or month as ``<column>_<chunk>``."""
    if chunk not in CHUNKS:
        raise ValueError(f"chunk must be one of {sorted(CHUNKS)}")
    if chunk == "day":
        return df, column
    name = f"{column}_{chunk}"
    return df.withColumn(name, F.to_date(F.date_trunc(chunk, column))), name


def partition_by_time(
    df: DataFrame, path: str, column: str = "order_date", mode: str = "overwrite", chunk: str = "day"
) -> None:
    """Store partitioned by time; overwriting replaces only the chunks written.

    A day suits a fact of some gigabytes per day; smaller facts take a week
    or a month per chunk.
    """
    rows, part = with_chunk(df, column, chunk)
    (
        by_time(rows, part)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )


class Folder:
    """A stored table's folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.make = jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.fs = self.make(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, below: str = "") -> bool:
        return self.fs.exists(self.make(self.path + below))

    def delete(self, below: str = "") -> None:
        self.fs.delete(self.make(self.path + below), True)

    def replace_by(self, other: str) -> None:
        """Put a finished folder in this one's place; readers find the old or the new one."""
        before = f"{self.path}_before_{uuid.uuid4().hex}"
        if self.exists():
            self.fs.rename(self.make(self.path), self.make(before))
        if not self.fs.rename(self.make(other), self.make(self.path)):
            raise OSError(f"cannot move {other} to {self.path}")
        self.fs.delete(self.make(before), True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write aside, then switch; ``df`` may read the table that it replaces."""
    folder = Folder(df.sparkSession, path)
    aside = f"{folder.path}_next_{uuid.uuid4().hex}"
    df.write.parquet(aside)
    folder.replace_by(aside)


def merge_by_time(
    df: DataFrame, path: str, keys: list[str], column: str = "order_date", chunk: str = "day"
) -> None:
    """Merge rows by key into a time-partitioned table: new rows replace stored ones of the same key.

    Only the chunks that hold new rows, or stored rows of their keys, are
    written again; all their other rows stay.  New rows must not repeat a key.
    """
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    if not folder.exists():
        return partition_by_time(df, path, column, chunk=chunk)
    rows, part = with_chunk(df, column, chunk)
    rows = stored(rows, "merge-new")
    old = spark.read.parquet(path)
    same_key = old.join(rows.select(*keys), keys, "left_semi").select(part).distinct()
    touched = stored(rows.select(part).distinct().unionAll(same_key).distinct(), "merge-chunks")
    known = touched.select(F.col(part).alias("_chunk"))  # a row without a date is in a chunk too
    kept = old.join(known, F.col(part).eqNullSafe(F.col("_chunk")), "left_semi").join(rows.select(*keys), keys, "left_anti")
    merged = stored(kept.select(*rows.columns).unionAll(rows), "merge-rows")
    # A chunk whose rows all moved elsewhere; one name per chunk without rows.
    left = merged.select(F.col(part).alias("_chunk")).distinct()
    empty = touched.join(left, F.col(part).eqNullSafe(F.col("_chunk")), "left_anti").collect()
    by_time(merged, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for (value,) in empty:
        folder.delete(f"/{part}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")


def write_mart(df: DataFrame, path: str, column: str = "date") -> None:
    """Replace the written dates of a daily mart, so that a rerun is harmless."""
    partition_by_time(df, path, column)


def append_fact(df: DataFrame, path: str, column: str = "order_date", chunk: str = "day") -> None:
    partition_by_time(df, path, column, mode="append", chunk=chunk)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    (
        df.write.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", str(batch))
        .options(**options)
        .mode(mode)
        .save()
    )


def refresh_materialized(df: DataFrame, path: str) -> DataFrame:
    """Recompute a stored view beside the old one, switch, and read it back."""
    replace_table(df, path)
    return df.sparkSession.read.parquet(path)


def latest_by(df: DataFrame, key: str, order_by: Column | str) -> DataFrame:
    """The last row of each key."""
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    last = F.max_by(F.struct("*"), order)
    return df.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")


def upsert_dimension(existing: DataFrame, new: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """New rows replace existing rows of the same key.

    Where the new rows may repeat a key, ``order_by`` names the column whose
    greatest value wins.
    """
    fresh = new if order_by is None else latest_by(new, key, order_by)
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def store_dimension(new: DataFrame, path: str, key: str, order_by: str | None = None) -> None:
    """Merge rows by key into a stored dimension."""
    spark = new.sparkSession
    if Folder(spark, path).exists():
        old = spark.read.parquet(path)
        new = upsert_dimension(old, stored(new, "upsert"), key, order_by).select(*old.columns)
    elif order_by is not None:
        new = latest_by(new, key, order_by)
    replace_table(new, path)


def write_csv_results(results: dict[str, DataFrame], folder: str, **options: str) -> None:
    """Each result as headered CSV below ``folder/name``."""
    for name, df in results.items():
        df.write.mode("overwrite").options(**options).option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def write_json_report(report: DataFrame, folder: str, name: str) -> None:
    report.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def expired_partitions(
    spark: SparkSession, table: str, column: str, as_of: dt.date, days: int, chunk: str = "day"
) -> DataFrame:
    """Chunks of a partitioned table that lie wholly before the retention."""
    value = F.to_date(F.regexp_extract("partition", rf"{column}=([^/]+)", 1))
    following = F.to_date(value + F.expr(CHUNKS[chunk]))
    return (
        spark.sql(f"SHOW PARTITIONS {table}")
        .where(following <= F.date_sub(F.lit(as_of), days))
        .select(value.alias(column))
    )


def drop_expired(
    spark: SparkSession, table: str, column: str, as_of: dt.date, days: int, chunk: str = "day"
) -> int:
    """Drop the expired chunks of a catalog table; kept chunks are untouched.

    The list read to the driver holds one entry per stored chunk.
    """
    dates = [r[0] for r in expired_partitions(spark, table, column, as_of, days, chunk).collect()]
    if dates:
        parts = ", ".join(f"PARTITION ({column} = DATE'{date}')" for date in dates)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")
    return len(dates)
