"""Log scans, health figures, activity and log views."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.aggregates import mean, ratio
from ..functions.dates import (
    day_key,
    days_before,
    gap_fill,
    grid_over,
    half_open,
    hour_key,
    lookback,
    moment,
    time_grid,
)
from ..functions.quantiles import exact_quantiles
from ..schemas import METRIC_NAME_PATTERN, RETENTION_DAYS, SEVERITIES

TS = "timestamp"


# ---- predicates ---------------------------------------------------------

def is_error_log() -> Column:
    """``error`` in the level or ``exception`` in the message."""
    level, message = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("level", "message"))
    return level.contains("error") | message.contains("exception")


def is_http_error() -> Column:
    return F.col("status_code") >= 400


def is_slow(threshold: float = 1000, column: str = "duration_ms", inclusive: bool = True) -> Column:
    c = F.col(column)
    return c >= threshold if inclusive else c > threshold


# ---- scans --------------------------------------------------------------

def scan_logs(logs: DataFrame, start, end, size: int | None = None) -> DataFrame:
    """Half-open range in time order.  ``size`` keeps only the first rows."""
    rows = half_open(logs, TS, start, end).orderBy(TS)
    return rows.limit(size) if size is not None else rows


def find_logs(logs: DataFrame, equal: dict | None = None, since=None) -> DataFrame:
    """Rows with the given values, from ``since`` on."""
    rows = logs
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows if since is None else rows.where(F.col(TS) >= moment(since))


def search_logs(
    logs: DataFrame,
    where: Column | str | None = None,
    sort: str = TS,
    descending: bool = True,
    size: int | None = None,
) -> DataFrame:
    rows = logs if where is None else logs.where(where)
    rows = rows.orderBy(F.desc(sort) if descending else F.asc(sort))
    return rows.limit(size) if size is not None else rows


def _closed_range(logs: DataFrame, start, end) -> DataFrame:
    return logs.where(F.col(TS).between(moment(start), moment(end)))


def error_search(logs: DataFrame, service: str, start, end, size: int | None = None) -> DataFrame:
    wanted = (F.lower("level") == "error") & (F.col("service") == service)
    return search_logs(_closed_range(logs, start, end), wanted, size=size)


def user_activity_search(logs: DataFrame, user_id, start, end, size: int | None = None) -> DataFrame:
    return search_logs(_closed_range(logs, start, end), F.col("user_id") == F.lit(user_id), size=size)


def performance_search(logs: DataFrame, threshold: float, start, end) -> DataFrame:
    """Slow rows: mean and maximum per service, and overall (null service)."""
    slow = _closed_range(logs, start, end).where(is_slow(threshold))
    return slow.rollup("service").agg(
        F.grouping("service").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("hits"),
        mean("duration_ms").alias("avg_duration"),
        F.max("duration_ms").alias("max_duration"),
    )


def apply_retention(logs: DataFrame, as_of, days: int | None = None, kind: str | None = None, ts: str = TS) -> DataFrame:
    """Rows young enough to be kept, by days or by kind of log."""
    if days is None:
        days = RETENTION_DAYS[kind]
    return logs.where(F.col(ts) >= days_before(as_of, days))


def filter_telemetry(df: DataFrame, severity: str | None = None, metric: str | None = None) -> DataFrame:
    """Keep wanted severities and metric names."""
    rows = df
    if severity is not None:
        rows = rows.where(F.col(severity).isin(SEVERITIES))
    if metric is not None:
        rows = rows.where(F.col(metric).rlike(METRIC_NAME_PATTERN))
    return rows


# ---- patterns, metrics, activity ----------------------------------------

def error_patterns(logs: DataFrame, start=None, end=None, samples: int = 3) -> DataFrame:
    """Per error type: count and the first sample messages in text order.

    Samples are the smallest distinct messages.  They are found with a rank
    limit that Spark applies before the shuffle, so the messages of a frequent
    type are never gathered.
    """
    rows = logs if start is None else half_open(logs, TS, start, end)
    errors = rows.where(is_error_log()).where(F.col("error_type").isNotNull())
    messages = errors.groupBy("error_type", "message").agg(F.count(TS).alias("n"))
    counts = messages.groupBy("error_type").agg(F.sum("n").alias("count"))
    rank = F.row_number().over(W.partitionBy("error_type").orderBy("message"))
    first = (
        messages.where(F.col("message").isNotNull())
        .select("error_type", "message")
        .withColumn("rank", rank)
        .where(F.col("rank") <= samples)
        .groupBy("error_type")
        .agg(F.sort_array(F.collect_list("message")).alias("messages"))
    )
    return counts.join(first, "error_type", "left").orderBy("error_type")


def _hours(logs: DataFrame, start, end) -> tuple[DataFrame, DataFrame]:
    """Rows in range and the hour grid they span.

    With given bounds the grid follows them; otherwise first to last row.
    """
    if start is None:
        return logs, grid_over(logs, TS, "hour", "1 hour", "hour")
    rows = half_open(logs, TS, start, end)
    grid = time_grid(logs.sparkSession, start, end, "1 hour", "hour")
    return rows, grid


def performance_metrics_hourly(logs: DataFrame, start=None, end=None) -> DataFrame:
    """Response time, memory and CPU per hour; empty hours are kept."""
    rows, grid = _hours(logs, start, end)
    per = rows.groupBy(F.date_trunc("hour", TS).alias("hour")).agg(
        mean("response_time").alias("response_time_mean"),
        F.max("response_time").cast("double").alias("response_time_max"),
        F.min("response_time").cast("double").alias("response_time_min"),
        F.count("response_time").alias("response_time_count"),
        mean("memory_usage").alias("memory_usage_mean"),
        mean("cpu_usage").alias("cpu_usage_mean"),
    )
    return gap_fill(grid, per, "hour", zero=("response_time_count",)).orderBy("hour")


def user_activity_hourly(logs: DataFrame, start=None, end=None) -> DataFrame:
    """Users, events and sessions per hour; empty hours count 0."""
    rows, grid = _hours(logs, start, end)
    counts = ("unique_users", "total_events", "unique_sessions")
    per = rows.groupBy(F.date_trunc("hour", TS).alias("hour")).agg(
        F.countDistinct("user_id").alias("unique_users"),
        F.count("event_type").alias("total_events"),
        F.countDistinct("session_id").alias("unique_sessions"),
    )
    return gap_fill(grid, per, "hour", zero=counts).orderBy("hour")


def system_health(logs: DataFrame, start=None, end=None) -> DataFrame:
    """One row: error and success rate, mean, p95 and p99 response time.

    A response time that is not a number is left out.
    """
    rows = logs if start is None else half_open(logs, TS, start, end)
    kind = logs.schema["response_time"].dataType.typeName()
    number = F.col("response_time").try_cast("double") if kind == "string" else F.col("response_time")
    rows = rows.select("status_code", number.alias("response_time"))
    errors = F.count_if(is_http_error())
    edges = exact_quantiles(rows, {"response_time": [0.95, 0.99]}).select("response_time").scalar()
    return (
        rows.agg(
            ratio(errors, F.count(F.lit(1))).alias("error_rate"),
            mean("response_time").alias("avg_response_time"),
            F.count(F.lit(1)).alias("total_requests"),
        )
        .withColumn("_q", edges)
        .select(
            "error_rate",
            "avg_response_time",
            F.col("_q")[0].alias("p95_response_time"),
            F.col("_q")[1].alias("p99_response_time"),
            (1 - F.col("error_rate")).alias("success_rate"),
            "total_requests",
        )
    )


# Sizes of the sketches: users within about 0.8 % (one standard error), response times within about 0.1 % of rank.
USERS_LG_K, TIMES_K = 14, 4096


def hourly_sketches(logs: DataFrame) -> DataFrame:
    """Requests and errors of each hour with sketches of its users and response times.

    Stored, an hour is a row of bounded size that merges with others, so any range of
    hours is answered without the raw rows.  Up to some thousand values the sketches are
    exact.
    """
    return logs.groupBy(F.date_trunc("hour", TS).alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_http_error()).alias("errors"),
        F.hll_sketch_agg("user_id", USERS_LG_K).alias("users"),
        F.kll_sketch_agg_double(F.col("response_time").cast("double"), TIMES_K).alias("times"),
    )


def health_from_hours(hours: DataFrame, by: str = "day", probs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Requests, error rate, users and response times per ``by`` (a day, a week, a month) from hourly sketches.

    A quantile is the smallest value of at least that share of the values; without any
    it is null.
    """
    merged = hours.groupBy(F.date_trunc(by, "hour").alias(by)).agg(
        F.sum("requests").alias("requests"),
        ratio(F.sum("errors"), F.sum("requests")).alias("error_rate"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"),
        F.kll_merge_agg_double("times").alias("_times"),
    )
    known = F.kll_sketch_get_n_double("_times") > 0
    quantiles = {f"p{round(100 * p)}": F.when(known, F.kll_sketch_get_quantile_double("_times", F.lit(p))) for p in probs}
    return merged.withColumns(quantiles).drop("_times")


def health_trends(logs: DataFrame, end, days: int = 7) -> DataFrame:
    """Error rate, response time and volume per 24 hours before ``end``.

    One pass over the range instead of one query per day; days without rows
    are kept.
    """
    last = moment(end)
    start = days_before(end, days)
    rows = logs.where((F.col(TS) >= start) & (F.col(TS) < last))
    index = F.floor((F.unix_micros(TS) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("int")
    per = rows.groupBy(index.alias("i")).agg(
        ratio(F.count_if(is_http_error()), F.count(F.lit(1))).alias("error_rate"),
        mean("response_time").alias("avg_response_time"),
        F.count(F.lit(1)).alias("total_requests"),
    )
    grid = logs.sparkSession.range(days).select(F.col("id").cast("int").alias("i"))
    return (
        gap_fill(grid, per, "i", zero=("total_requests",))
        .select(
            F.to_date(start + F.make_dt_interval(F.col("i"))).alias("date"),
            "error_rate",
            "avg_response_time",
            "total_requests",
        )
        .orderBy("date")
    )


def system_health_hourly(logs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    since = moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (
        logs.where(F.col(TS) >= since)
        .groupBy(F.date_trunc("hour", TS).alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            mean("response_time").alias("avg_response_time"),
            F.max("response_time").cast("double").alias("max_response_time"),
            F.count_if(is_http_error()).alias("error_count"),
        )
        .orderBy("hour")
    )


def error_distribution(logs: DataFrame, as_of, days: int = 1) -> DataFrame:
    return (
        lookback(logs, TS, days, as_of)
        .where(is_http_error())
        .groupBy("error_type")
        .agg(
            F.count(F.lit(1)).alias("error_count"),
            mean("response_time").alias("avg_response_time"),
        )
        .orderBy(F.desc("error_count"), "error_type")
    )


def slow_queries(
    logs: DataFrame, as_of, days: int = 1, threshold: float = 1000, time_column: str = "duration_ms"
) -> DataFrame:
    return (
        lookback(logs, TS, days, as_of)
        .where(is_slow(threshold, time_column, inclusive=False))
        .groupBy("query_text")
        .agg(
            F.count(F.lit(1)).alias("execution_count"),
            mean(time_column).alias("avg_execution_time"),
            F.max(time_column).alias("max_execution_time"),
        )
        .orderBy(F.desc("avg_execution_time"), "query_text")
    )


def latency_summary(logs: DataFrame, column: str = "response_time") -> DataFrame:
    """Minimum, maximum, mean, median, p95 and p99 of a numeric column."""
    edges = exact_quantiles(logs, {column: [0.5, 0.95, 0.99]}).select(column).scalar()
    c = F.col(column)
    return (
        logs.agg(
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            mean(c).alias("avg"),
            F.count(c).alias("count"),
        )
        .withColumn("_q", edges)
        .select(
            "min", "max", "avg", "count",
            F.col("_q")[0].alias("median"),
            F.col("_q")[1].alias("p95"),
            F.col("_q")[2].alias("p99"),
        )
    )


# ---- stored views -------------------------------------------------------

def _with_elements(per_element: DataFrame, keys: list[str], figures: dict[str, Column]) -> DataFrame:
    """One row per key and element, with the figures of the whole key beside them.

    Sets stay rows at every size: nothing is gathered into one cell or task.
    """
    groups = per_element.groupBy(*keys).agg(*[c.alias(n) for n, c in figures.items()])
    same = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    rest = [f"e.{c}" for c in per_element.columns if not c.startswith("_") and c not in keys]
    return per_element.alias("e").join(groups.alias("g"), same).select("g.*", *rest)


def error_summary(logs: DataFrame) -> DataFrame:
    """Error type by service by day: count, first, last, and a row per message with its count."""
    keys = ["error_type", "service", "day"]
    per_message = (
        logs.withColumn("day", day_key(TS))
        .groupBy(*keys, F.col("message").alias("error_message"))
        .agg(F.count(F.lit(1)).alias("message_count"), F.min(TS).alias("_first"), F.max(TS).alias("_last"))
    )
    figures = {
        "count": F.sum("message_count"),
        "first_occurrence": F.min("_first"),
        "last_occurrence": F.max("_last"),
    }
    return _with_elements(per_message, keys, figures)


def user_activity(logs: DataFrame) -> DataFrame:
    """User by day: requests, first and last access, and a row per endpoint with its count."""
    keys = ["user_id", "day"]
    per_endpoint = (
        logs.withColumn("day", day_key(TS))
        .groupBy(*keys, "endpoint")
        .agg(F.count(F.lit(1)).alias("endpoint_requests"), F.min(TS).alias("_first"), F.max(TS).alias("_last"))
    )
    figures = {
        "total_requests": F.sum("endpoint_requests"),
        "first_access": F.min("_first"),
        "last_access": F.max("_last"),
    }
    return _with_elements(per_endpoint, keys, figures)


def metric_rows(logs: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide log rows as one ``metric, value`` row per metric.

    Values keep their digits: decimals of a scale that holds every metric, else doubles.
    """
    types = [logs.schema[m].dataType for m in metrics]
    exact = all(isinstance(t, (T.DecimalType, T.IntegralType)) for t in types)
    scale = max((t.scale for t in types if isinstance(t, T.DecimalType)), default=0)
    kind = f"decimal(38,{scale})" if exact else "double"
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast(kind).alias("value"))
            for m in metrics
        ]
    )
    return logs.select(TS, "service", F.explode(pairs).alias("p")).select(TS, "service", "p.*")


def performance_metrics(rows: DataFrame) -> DataFrame:
    """Service by metric by hour: mean, minimum, maximum, count."""
    return rows.groupBy("service", "metric", hour_key(TS).alias("hour")).agg(
        mean("value").alias("avg_value"),
        F.min("value").cast("double").alias("min_value"),
        F.max("value").cast("double").alias("max_value"),
        F.count(F.lit(1)).alias("count"),
    )


# ---- alerts and rates over stored logs ----------------------------------

def rate_alerts(
    logs: DataFrame,
    error_share: float = 0.05,
    mean_latency: float = 0.5,
    hold_minutes: int = 2,
    server_error: int = 500,
) -> DataFrame:
    """Five-minute windows, every minute, whose error share or mean latency
    stays above its limit for ``hold_minutes`` windows in a row.

    Latency is in the unit of ``response_time``.  Rows are summed per minute
    before they spread over the five windows that hold the minute.
    """
    minute = F.date_trunc("minute", TS)
    per_minute = logs.groupBy("service", minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= server_error).alias("errors"),
        F.sum("response_time").alias("latency"),
        F.count("response_time").alias("timed"),
    )
    windows = (
        per_minute.groupBy("service", F.window("minute", "5 minutes", "1 minute").alias("w"))
        .agg(
            F.sum("requests").alias("requests"),
            ratio(F.sum("errors"), F.sum("requests")).alias("error_rate"),
            ratio(F.sum("latency"), F.sum("timed")).alias("avg_latency"),
        )
        .select(
            "service",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "requests",
            "error_rate",
            "avg_latency",
        )
    )
    # One row per service and minute: the frame is the last minutes only.
    held = (
        W.partitionBy("service")
        .orderBy(F.unix_seconds("window_start"))
        .rangeBetween(-60 * hold_minutes, 0)
    )

    def lasting(breach: Column) -> Column:
        return F.count_if(breach).over(held) == hold_minutes + 1

    return windows.withColumns(
        {
            "high_error_rate": lasting(F.col("error_rate") > error_share),
            "high_latency": lasting(F.col("avg_latency") > mean_latency),
        }
    ).where("high_error_rate or high_latency")


def over_limit(df: DataFrame, keys: list[str], ts: str, window: str, limit: int, inclusive: bool = False) -> DataFrame:
    """Keys with more than ``limit`` rows in a clock-aligned window."""
    n = F.col("requests")
    return (
        df.groupBy(*keys, F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(n >= limit if inclusive else n > limit)
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")
    )


def fixed_window_rate(logs: DataFrame, key: str, window: str = "1 hour", limit: int = 1000) -> DataFrame:
    return over_limit(logs, [key], TS, window, limit)


def failed_login_alert(logins: DataFrame, limit: int = 5) -> DataFrame:
    """At least ``limit`` failures of one user from one address in an hour."""
    return over_limit(logins, ["user_id", "ip_address"], TS, "1 hour", limit, inclusive=True)


# ---- reports ------------------------------------------------------------

def daily_log_report(logs: DataFrame, day: dt.date | str) -> DataFrame:
    """The four analyses of one day, one row per entry: section, key, JSON.

    The report stays rows, so a day with very many error types is never one
    document in one task.
    """
    start = dt.date.fromisoformat(str(day))
    end = start + dt.timedelta(days=1)

    def section(name: str, df: DataFrame, key: Column) -> DataFrame:
        return df.select(
            F.lit(start).alias("date"),
            F.lit(name).alias("section"),
            key.cast("string").alias("entry"),
            F.to_json(F.struct("*")).alias("figures"),
        )

    return (
        section("error_patterns", error_patterns(logs, start, end), F.col("error_type"))
        .unionByName(section("performance_metrics", performance_metrics_hourly(logs, start, end), F.col("hour")))
        .unionByName(section("user_activity", user_activity_hourly(logs, start, end), F.col("hour")))
        .unionByName(section("system_health", system_health(logs, start, end), F.lit("all")))
    )


def trend_report(trends: DataFrame) -> DataFrame:
    """The trend series as one row of arrays in date order, one element a day."""
    row = F.sort_array(F.collect_list(F.struct("date", "error_rate", "avg_response_time", "total_requests")))
    return trends.agg(row.alias("r")).select(
        F.col("r.error_rate").alias("error_rate_trend"),
        F.col("r.avg_response_time").alias("response_time_trend"),
        F.col("r.total_requests").alias("request_volume_trend"),
        F.col("r.date").alias("dates"),
    )
