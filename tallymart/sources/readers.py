"""Batch and streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import check_range, moment
from ..schemas import ACCESS_LOG, APPLICATION_LOG, CSV_FILES

CORRUPT = "_corrupt"

# Days and months of the web server's time format.
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def parse_json(messages: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Flat message columns plus ``_corrupt``: the text of an unreadable message."""
    with_text = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    data = F.from_json(
        F.col(column).cast("string"),
        with_text,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return messages.select(data.alias("data")).select("data.*")


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_messages(spark: SparkSession, topic: str, source: str = "kafka", **options: str) -> DataFrame:
    """An unbounded frame with a ``value`` column.

    Kafka by default (``kafka.bootstrap.servers`` in the options); ``text``
    reads files of JSON lines from ``<path>/<topic>`` as they arrive.
    """
    if source == "kafka":
        options.setdefault("subscribe", topic)
        return spark.readStream.format("kafka").options(**options).load().select("value", "timestamp")
    path = options.pop("path").rstrip("/")
    return spark.readStream.format(source).options(**options).load(f"{path}/{topic}")


def read_json_stream(
    spark: SparkSession, topic: str, schema: T.StructType, source: str = "kafka", **options: str
) -> DataFrame:
    """Decoded columns of the well-formed messages of a topic."""
    return good_rows(parse_json(read_messages(spark, topic, source, **options), schema))


def read_lake(spark: SparkSession, path: str, start, end, strict_end: bool = False) -> DataFrame:
    """Hourly rows whose window lies in the range.

    ``strict_end=True`` asks for ``window.end < end``, which loses the last
    hour of the range; by default that hour is kept.
    """
    return in_range(spark.read.parquet(path), start, end, strict_end)


def in_range(lake: DataFrame, start, end, strict_end: bool = False) -> DataFrame:
    check_range(start, end)
    last = F.col("window.end")
    inside = last < moment(end) if strict_end else last <= moment(end)
    return lake.where((F.col("window.start") >= moment(start)) & inside)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """A headered CSV extract with doubled quotes inside quoted fields.

    ``multi_line`` allows line breaks inside fields; each file is then read by
    one task, so such extracts should come as many files.
    """
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line).csv(path)


def read_extract(spark: SparkSession, folder: str, name: str, file: str | None = None) -> DataFrame:
    """One of the known extracts of a folder by its short name.

    ``file`` overrides the file name, for extracts that are named differently.
    """
    usual, schema = CSV_FILES[name]
    file = file or usual
    return read_csv(spark, f"{folder.rstrip('/')}/{file}", schema)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_query(spark: SparkSession, query: str, **params) -> DataFrame:
    """SQL with named parameters (``:name``) over the session's tables."""
    return spark.sql(query, args=params)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower=None,
    upper=None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A database table or ``(query) alias``, read in ranges of a column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return reader.load()


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the web server as typed log rows."""
    parts = F.split("request", " ")
    return spark.read.schema(ACCESS_LOG).json(path).select(
        F.try_to_timestamp("time_local", F.lit(ACCESS_TIME)).alias("timestamp"),
        F.col("remote_addr").alias("ip_address"),
        F.col("remote_user").alias("user_id"),
        F.get(parts, 0).alias("method"),
        F.get(parts, 1).alias("endpoint"),
        F.col("status").try_cast("int").alias("status_code"),
        F.col("body_bytes_sent").try_cast("bigint").alias("bytes_sent"),
        F.col("request_time").try_cast("double").alias("response_time"),
        "request_id",
        "trace_id",
    )


def read_application_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the application as typed log rows."""
    stamp = F.regexp_replace("timestamp", ",", ".")
    rows = spark.read.schema(APPLICATION_LOG).json(path)
    return rows.withColumn("timestamp", stamp.try_cast("timestamp"))
