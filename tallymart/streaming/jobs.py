"""Hourly event-time aggregates over message streams.

Every job takes a frame of decoded messages and works the same on a batch
frame, apart from late rows, which only a stream drops.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.aggregates import mean, ratio, total
from ..functions.dates import calendar_days, parse_iso
from ..schemas import MESSAGES
from ..sources.readers import read_json_stream
from ..sources.writers import lake_stream_sink

LATENESS = "1 hour"
WINDOW = "1 hour"


def _event_time(df: DataFrame, column: str) -> DataFrame:
    """ISO text to event time.  A message without one belongs to no window."""
    return (
        df.withColumn("event_time", parse_iso(column))
        .where("event_time is not null")
        .withWatermark("event_time", LATENESS)
    )


def new_customers(customers: DataFrame) -> DataFrame:
    """Customer messages per hour."""
    return (
        _event_time(customers, "timestamp")
        .groupBy(F.window("event_time", WINDOW))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def with_delay(orders: DataFrame) -> DataFrame:
    """Calendar days of delivery after the estimate; null before delivery."""
    delivered, promised = parse_iso("order_delivered_customer_date"), parse_iso("order_estimated_delivery_date")
    return orders.withColumn(
        "delivery_delay", F.when(delivered.isNotNull(), calendar_days(delivered, promised))
    )


def order_stats(orders: DataFrame) -> DataFrame:
    """Orders, mean delay and exact number of customers per hour.

    A stream cannot count distinct values directly.  The rows are first summed
    per hour and customer, then per hour, so each customer is one row.
    """
    per_customer = (
        _event_time(with_delay(orders), "order_purchase_timestamp")
        .groupBy(F.window("event_time", WINDOW), "customer_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("delivery_delay").alias("delay"),
            F.count("delivery_delay").alias("delivered"),
        )
    )
    return (
        per_customer.groupBy(F.window(F.window_time("window"), WINDOW))
        .agg(
            F.sum("orders").alias("total_orders"),
            ratio(F.sum("delay"), F.sum("delivered")).alias("avg_delivery_delay"),
            F.count("customer_id").alias("unique_customers"),
        )
    )


def sales_stats(order_items: DataFrame) -> DataFrame:
    """Item sales per hour from messages that carry the lines of an order.

    Amounts are summed as decimals, so the order of arrival does not matter.
    """
    items = _event_time(order_items, "timestamp").select("event_time", F.explode("items").alias("item"))
    money = {c: F.col(c).cast("decimal(18,2)") for c in ("price", "freight_value")}
    return (
        items.select("event_time", "item.*")
        .withColumns(money)
        .groupBy(F.window("event_time", WINDOW))
        .agg(
            total("price").alias("total_sales"),
            mean("price").alias("avg_price"),
            total("freight_value").alias("total_freight"),
            F.count("order_id").alias("total_items"),
        )
    )


# Lake table, topic and job of the three hourly aggregates.
JOBS = {
    "customers": ("customers", new_customers),
    "orders": ("orders", order_stats),
    "sales": ("order_items", sales_stats),
}


def start_jobs(
    spark: SparkSession, lake: str, source: str = "kafka", available_now: bool = False, **options: str
) -> list[StreamingQuery]:
    """Start the three hourly jobs."""
    queries = []
    for name, (topic, job) in JOBS.items():
        messages = read_json_stream(spark, topic, MESSAGES[topic], source, **options)
        queries.append(lake_stream_sink(job(messages), lake, name, available_now=available_now))
    return queries


def start_landing(
    spark: SparkSession, lake: str, source: str = "kafka", available_now: bool = False, **options: str
) -> list[StreamingQuery]:
    """Land the decoded rows of all five topics below ``<lake>/raw``."""
    return [
        lake_stream_sink(
            read_json_stream(spark, topic, schema, source, **options),
            f"{lake.rstrip('/')}/raw",
            topic,
            available_now=available_now,
        )
        for topic, schema in MESSAGES.items()
    ]


def run_until_failure(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Wait for all jobs; when any one fails, stop the others and raise."""
    try:
        while any(q.isActive for q in queries):
            spark.streams.awaitAnyTermination()
            spark.streams.resetTerminated()
        for q in queries:
            if q.exception():
                raise q.exception()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


def supervise(
    spark: SparkSession, starts: dict[str, Callable[[], StreamingQuery]], tries: int = 3, pause: float = 0.0
) -> dict[str, int]:
    """Run several queries until all have ended; how often each was started again.

    A query that fails is started again by its own function, which goes on from its
    checkpoint, up to ``tries`` starts in all, with ``pause`` seconds before each further
    one; the others go on meanwhile.  If any has used up its tries, its error is raised
    once the others have ended.
    """
    running = {name: start() for name, start in starts.items()}
    restarts: dict[str, int] = {}
    failed: dict[str, Exception] = {}
    try:
        while running:
            try:
                spark.streams.awaitAnyTermination(1)
            except StreamingQueryException:  # whose it is, the queries tell
                pass
            spark.streams.resetTerminated()
            for name, query in list(running.items()):
                if query.isActive:
                    continue
                error = query.exception()
                if error is None:
                    del running[name]
                elif restarts.get(name, 0) + 1 >= tries:
                    failed[name] = error
                    del running[name]
                else:
                    restarts[name] = restarts.get(name, 0) + 1
                    time.sleep(pause)
                    running[name] = starts[name]()
    finally:
        for query in running.values():
            if query.isActive:
                query.stop()
    if failed:
        name, error = next(iter(failed.items()))
        raise RuntimeError(f"gave up on {', '.join(sorted(failed))} after {tries} tries") from error
    return restarts


class Watcher(StreamingQueryListener):
    """Batches, rows, starts and errors of the session's queries by name; register with ``spark.streams.addListener``."""

    def __init__(self):
        self.names: dict[str, str] = {}
        self.figures: dict[str, dict] = {}

    def _of(self, query_id: str) -> dict:
        return self.figures.setdefault(self.names.get(query_id, query_id), {"starts": 0, "batches": 0, "rows": 0, "errors": []})

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self._of(str(event.id))["starts"] += 1

    def onQueryProgress(self, event) -> None:
        seen = self._of(str(event.progress.id))
        seen["batches"] += 1
        seen["rows"] += max(0, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._of(str(event.id))["errors"].append(event.exception)


# ---- alerts over streams ------------------------------------------------

def rate_windows(logs: DataFrame) -> DataFrame:
    """Five-minute rates every minute, for alert rules on a stream.

    Rows are summed per minute before they spread over the five windows that
    hold the minute.  Whether a breach lasts is decided on the stored windows.
    """
    per_minute = (
        logs.withWatermark("timestamp", LATENESS)
        .groupBy("service", F.window("timestamp", "1 minute"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status_code") >= 500).alias("errors"),
            F.sum("response_time").alias("latency"),
            F.count("response_time").alias("timed"),
        )
    )
    return (
        per_minute.groupBy("service", F.window(F.window_time("window"), "5 minutes", "1 minute"))
        .agg(
            F.sum("requests").alias("requests"),
            ratio(F.sum("errors"), F.sum("requests")).alias("error_rate"),
            ratio(F.sum("latency"), F.sum("timed")).alias("avg_latency"),
        )
    )


def held_alerts(logs: DataFrame, error_share: float = 0.05, mean_latency: float = 0.5, hold_minutes: int = 2) -> DataFrame:
    """Windows of ``rate_windows`` that are over a limit, as are those of the ``hold_minutes`` minutes before.

    A window is counted in every stretch of that many minutes that it ends in; one in
    which all minutes are over the limit alerts.  The counts are state, so a breach may
    reach over micro-batches.
    """
    steps = hold_minutes + 1
    over = rate_windows(logs).withColumns(
        {"errors_over": F.col("error_rate") > error_share, "latency_over": F.col("avg_latency") > mean_latency}
    ).where("errors_over OR latency_over")
    ends = F.window_time("window")
    held = over.groupBy("service", F.window(ends, f"{steps} minutes", "1 minute").alias("held")).agg(
        F.count_if("errors_over").alias("errors_over"),
        F.count_if("latency_over").alias("latency_over"),
        F.max(F.struct("window", "requests", "error_rate", "avg_latency")).alias("last"),
    )
    return held.where((F.col("errors_over") == steps) | (F.col("latency_over") == steps)).select(
        "service", "last.window", "last.requests", "last.error_rate", "last.avg_latency",
        (F.col("errors_over") == steps).alias("high_error_rate"), (F.col("latency_over") == steps).alias("high_latency"),
    )


def request_windows(logs: DataFrame, keys: list[str], window: str, limit: int) -> DataFrame:
    """Keys that reach a request limit in a clock-aligned window."""
    return (
        logs.withWatermark("timestamp", LATENESS)
        .groupBy(*keys, F.window("timestamp", window))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") >= limit)
    )
