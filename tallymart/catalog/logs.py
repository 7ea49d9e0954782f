"""Named queries: log scans, health, activity, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs
from ..session import scratch_dir
from .registry import LOG_AS_OF, LOG_END, LOG_START, query, rounded
from .staging_sql import mean, with_staging

TS = '"timestamp"'
RANGE = f"{TS} >= TIMESTAMP '{LOG_START}' AND {TS} < TIMESTAMP '{LOG_END}'"
CLOSED = f"{TS} BETWEEN TIMESTAMP '{LOG_START}' AND TIMESTAMP '{LOG_END}'"
LOG_COLUMNS = ["timestamp", "level", "message", "service", "user_id", "event_type", "status_code", "duration_ms"]
COLUMN_SQL = ", ".join(f'"{c}"' for c in LOG_COLUMNS)


def flat(df):
    return df.select(*LOG_COLUMNS)


@query("scan_logs", with_staging(f"SELECT {COLUMN_SQL} FROM logs WHERE {RANGE}"))
def scan_logs(t):
    return flat(logs.scan_logs(t.logs, LOG_START, LOG_END))


@query("find_logs", with_staging(
    f"SELECT {COLUMN_SQL} FROM logs WHERE level = 'ERROR' AND {TS} >= TIMESTAMP '{LOG_START}'"))
def find_logs(t):
    return flat(logs.find_logs(t.logs, {"level": "ERROR"}, LOG_START))


@query("search_logs", with_staging(
    f"SELECT {COLUMN_SQL} FROM logs WHERE status_code >= 400 OR duration_ms >= 10000"))
def search_logs(t):
    return flat(logs.search_logs(t.logs, "status_code >= 400 or duration_ms >= 10000"))


@query("error_search", with_staging(
    f"SELECT {COLUMN_SQL} FROM logs WHERE lower(level) = 'error' AND service = 'svc1' AND {CLOSED}"))
def error_search(t):
    return flat(logs.error_search(t.logs, "svc1", LOG_START, LOG_END))


@query("user_activity_search", with_staging(f"SELECT {COLUMN_SQL} FROM logs WHERE user_id = 7 AND {CLOSED}"))
def user_activity_search(t):
    return flat(logs.user_activity_search(t.logs, 7, LOG_START, LOG_END))


@query("performance_search", with_staging(f"""
SELECT service, CAST(GROUPING(service) AS INT) AS is_total, COUNT(*) AS hits,
  {mean('duration_ms')} AS avg_duration, MAX(duration_ms) AS max_duration
FROM logs WHERE duration_ms >= 1000 AND {CLOSED} GROUP BY ROLLUP (service)"""))
def performance_search(t):
    return logs.performance_search(t.logs, 1000, LOG_START, LOG_END)


@query("apply_retention", with_staging(
    f"SELECT {COLUMN_SQL} FROM logs WHERE {TS} >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY"))
def apply_retention(t):
    return flat(logs.apply_retention(t.logs, "2024-02-20", kind="indexed_logs"))


@query("filter_telemetry", with_staging(f"""
SELECT {TS}, service, 'duration_ms' AS metric, CAST(duration_ms AS DOUBLE) AS value
FROM logs WHERE level IN ('ERROR', 'WARN', 'INFO')"""))
def filter_telemetry(t):
    kept = logs.filter_telemetry(t.logs, severity="level")
    rows = logs.metric_rows(kept, ["response_time", "duration_ms", "cpu_usage"])
    return logs.filter_telemetry(rows, metric="metric").withColumn("value", F.col("value").cast("double"))


@query("error_patterns", with_staging("""
SELECT c.error_type, c.count, m.messages
FROM (SELECT error_type, COUNT(*) AS count FROM logs WHERE level = 'ERROR' GROUP BY 1) c
JOIN (SELECT error_type, string_agg(message, '|' ORDER BY message) AS messages
  FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY message) AS rn
    FROM (SELECT DISTINCT error_type, message FROM logs WHERE level = 'ERROR'))
  WHERE rn <= 3 GROUP BY 1) m ON c.error_type = m.error_type"""))
def error_patterns(t):
    return logs.error_patterns(t.logs).withColumn("messages", F.array_join("messages", "|"))


GRID = f"""hours AS (
  SELECT unnest(range(TIMESTAMP '{LOG_START}', TIMESTAMP '{LOG_END}', INTERVAL 1 HOUR)) AS hour)"""


@query("performance_metrics_hourly", with_staging(f"""
SELECT h.hour, {mean('response_time')} AS response_time_mean,
  CAST(MAX(response_time) AS DOUBLE) AS response_time_max, CAST(MIN(response_time) AS DOUBLE) AS response_time_min,
  COUNT(response_time) AS response_time_count, {mean('memory_usage')} AS memory_usage_mean,
  {mean('cpu_usage')} AS cpu_usage_mean
FROM hours h LEFT JOIN logs l ON date_trunc('hour', l.{TS}) = h.hour GROUP BY 1""", GRID))
def performance_metrics_hourly(t):
    return logs.performance_metrics_hourly(t.logs, LOG_START, LOG_END)


@query("user_activity_hourly", with_staging(f"""
SELECT h.hour, COUNT(DISTINCT user_id) AS unique_users, COUNT(event_type) AS total_events,
  COUNT(DISTINCT session_id) AS unique_sessions
FROM hours h LEFT JOIN logs l ON date_trunc('hour', l.{TS}) = h.hour GROUP BY 1""", GRID))
def user_activity_hourly(t):
    return logs.user_activity_hourly(t.logs, LOG_START, LOG_END)


@query("system_health", with_staging(f"""
SELECT e AS error_rate, m AS avg_response_time, round(p95, 6) AS p95_response_time,
  round(p99, 6) AS p99_response_time, 1 - e AS success_rate, n AS total_requests
FROM (SELECT CAST(SUM(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS e,
    {mean('response_time')} AS m, quantile_cont(CAST(response_time AS DOUBLE), 0.95) AS p95,
    quantile_cont(CAST(response_time AS DOUBLE), 0.99) AS p99, COUNT(*) AS n
  FROM logs WHERE {RANGE})"""))
def system_health(t):
    out = logs.system_health(t.logs, LOG_START, LOG_END)
    return rounded(out, "p95_response_time", "p99_response_time", digits=6)


TRENDS = f"""trends AS (
  SELECT CAST(d AS DATE) AS date,
    CAST(SUM(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(event_type), 0) AS error_rate,
    {mean('response_time')} AS avg_response_time, COUNT(event_type) AS total_requests
  FROM (SELECT unnest(range(TIMESTAMP '{LOG_START}', TIMESTAMP '{LOG_END}', INTERVAL 1 DAY)) AS d) days
  LEFT JOIN logs l ON date_trunc('day', l.{TS}) = d GROUP BY 1)"""


@query("health_trends", with_staging("SELECT * FROM trends", TRENDS))
def health_trends(t):
    return logs.health_trends(t.logs, LOG_END, 30)


@query("trend_report", with_staging("""
SELECT string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) AS dates,
  string_agg(CAST(total_requests AS VARCHAR), ',' ORDER BY date) AS request_volume_trend,
  list(round(error_rate, 9) ORDER BY date) AS error_rate_trend,
  list(round(avg_response_time, 9) ORDER BY date) AS response_time_trend FROM trends""", TRENDS))
def trend_report(t):
    report = logs.trend_report(logs.health_trends(t.logs, LOG_END, 30))
    exact = lambda c: F.transform(c, lambda x: F.round(x, 9))
    return report.select(
        F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"),
        F.array_join(F.col("request_volume_trend").cast("array<string>"), ",").alias("request_volume_trend"),
        exact("error_rate_trend").alias("error_rate_trend"),
        exact("response_time_trend").alias("response_time_trend"),
    )


LAST_DAY = f"{TS} >= TIMESTAMP '{LOG_AS_OF}' - INTERVAL 1 DAY"


@query("system_health_hourly", with_staging(f"""
SELECT date_trunc('hour', {TS}) AS hour, COUNT(*) AS total_requests, {mean('response_time')} AS avg_response_time,
  CAST(MAX(response_time) AS DOUBLE) AS max_response_time,
  CAST(SUM(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_count
FROM logs WHERE {LAST_DAY} GROUP BY 1"""))
def system_health_hourly(t):
    return logs.system_health_hourly(t.logs, LOG_AS_OF)


@query("error_distribution", with_staging(f"""
SELECT error_type, COUNT(*) AS error_count, {mean('response_time')} AS avg_response_time
FROM logs WHERE status_code >= 400 AND {LAST_DAY} GROUP BY 1"""))
def error_distribution(t):
    return logs.error_distribution(t.logs, LOG_AS_OF)


@query("slow_queries", with_staging(f"""
SELECT query_text, COUNT(*) AS execution_count, {mean('duration_ms')} AS avg_execution_time,
  MAX(duration_ms) AS max_execution_time
FROM logs WHERE duration_ms > 1000 AND {LAST_DAY} GROUP BY 1"""))
def slow_queries(t):
    return logs.slow_queries(t.logs, LOG_AS_OF)


@query("health_from_hours", with_staging(f"""
SELECT date_trunc('day', {TS}) AS day, COUNT(*) AS requests,
  CAST(SUM(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS error_rate,
  COUNT(DISTINCT user_id) AS unique_users, CAST(quantile_disc(response_time, 0.5) AS DOUBLE) AS p50,
  CAST(quantile_disc(response_time, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(response_time, 0.99) AS DOUBLE) AS p99
FROM logs GROUP BY 1"""))
def health_from_hours(t):
    """Days from stored hours; the sketches are exact for as many rows a day as the given tables have."""
    path = scratch_dir(t.spark, "hours")
    logs.hourly_sketches(t.logs).write.parquet(path)
    return logs.health_from_hours(t.spark.read.parquet(path))


@query("latency_summary", with_staging(f"""
SELECT CAST(MIN(response_time) AS DOUBLE) AS min, CAST(MAX(response_time) AS DOUBLE) AS max,
  {mean('response_time')} AS avg, COUNT(response_time) AS count,
  round(quantile_cont(CAST(response_time AS DOUBLE), 0.5), 6) AS median,
  round(quantile_cont(CAST(response_time AS DOUBLE), 0.95), 6) AS p95,
  round(quantile_cont(CAST(response_time AS DOUBLE), 0.99), 6) AS p99
FROM logs"""))
def latency_summary(t):
    return rounded(logs.latency_summary(t.logs), "median", "p95", "p99", digits=6)


@query("error_summary", with_staging(f"""
SELECT k.*, message AS error_message, n AS message_count
FROM (SELECT error_type, service, strftime({TS}, '%Y-%m-%d') AS day, COUNT(*) AS count,
    MIN({TS}) AS first_occurrence, MAX({TS}) AS last_occurrence FROM logs WHERE level = 'ERROR' GROUP BY 1, 2, 3) k
JOIN (SELECT error_type AS t, service AS s, strftime({TS}, '%Y-%m-%d') AS d, message, COUNT(*) AS n
  FROM logs WHERE level = 'ERROR' GROUP BY 1, 2, 3, 4) m
ON t IS NOT DISTINCT FROM k.error_type AND s IS NOT DISTINCT FROM k.service AND d = k.day"""))
def error_summary(t):
    return logs.error_summary(t.logs.where("level = 'ERROR'"))


@query("user_activity", with_staging(f"""
SELECT k.*, endpoint, n AS endpoint_requests
FROM (SELECT user_id, strftime({TS}, '%Y-%m-%d') AS day, COUNT(*) AS total_requests,
    MIN({TS}) AS first_access, MAX({TS}) AS last_access FROM logs GROUP BY 1, 2) k
JOIN (SELECT user_id AS u, strftime({TS}, '%Y-%m-%d') AS d, endpoint, COUNT(*) AS n FROM logs GROUP BY 1, 2, 3) e
ON u IS NOT DISTINCT FROM k.user_id AND d = k.day"""))
def user_activity(t):
    return logs.user_activity(t.logs)


@query("performance_metrics", with_staging(f"""
SELECT service, metric, strftime({TS}, '%Y-%m-%d %H:00:00') AS hour, {mean('value')} AS avg_value,
  CAST(MIN(value) AS DOUBLE) AS min_value, CAST(MAX(value) AS DOUBLE) AS max_value, COUNT(*) AS count
FROM (SELECT {TS}, service, 'response_time' AS metric, CAST(response_time AS DECIMAL(18,4)) AS value FROM logs
  UNION ALL SELECT {TS}, service, 'duration_ms', CAST(duration_ms AS DECIMAL(18,4)) FROM logs) GROUP BY 1, 2, 3"""))
def performance_metrics(t):
    return logs.performance_metrics(logs.metric_rows(t.logs, ["response_time", "duration_ms"]))


@query("rate_alerts", with_staging("""
SELECT * FROM (
  SELECT service, window_start, window_start + INTERVAL 5 MINUTE AS window_end, requests, error_rate, avg_latency,
    SUM(CASE WHEN error_rate > 0.05 THEN 1 ELSE 0 END) OVER held = 3 AS high_error_rate,
    SUM(CASE WHEN avg_latency > 100 THEN 1 ELSE 0 END) OVER held = 3 AS high_latency
  FROM windows WINDOW held AS (PARTITION BY service ORDER BY window_start
    RANGE BETWEEN INTERVAL 2 MINUTE PRECEDING AND CURRENT ROW))
WHERE high_error_rate OR high_latency""", f"""windows AS (
  SELECT service, m - k * INTERVAL 1 MINUTE AS window_start, COUNT(*) AS requests,
    CAST(SUM(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS error_rate,
    {mean('response_time')} AS avg_latency
  FROM (SELECT *, date_trunc('minute', {TS}) AS m FROM logs), (SELECT unnest(range(5)) AS k) steps
  GROUP BY 1, 2)"""))
def rate_alerts(t):
    return logs.rate_alerts(t.logs, mean_latency=100)


@query("fixed_window_rate", with_staging(f"""
SELECT service, time_bucket(INTERVAL 1 HOUR, {TS}) AS window_start,
  time_bucket(INTERVAL 1 HOUR, {TS}) + INTERVAL 1 HOUR AS window_end, COUNT(*) AS requests
FROM logs GROUP BY 1, 2, 3 HAVING COUNT(*) > 5"""))
def fixed_window_rate(t):
    return logs.fixed_window_rate(t.logs, "service", limit=5)


@query("failed_login_alert", with_staging(f"""
SELECT user_id, ip_address, time_bucket(INTERVAL 1 HOUR, {TS}) AS window_start,
  time_bucket(INTERVAL 1 HOUR, {TS}) + INTERVAL 1 HOUR AS window_end, COUNT(*) AS requests
FROM logs WHERE event_type = 'error' GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 2"""))
def failed_login_alert(t):
    return logs.failed_login_alert(t.logs.where("event_type = 'error'"), limit=2)


DAY = "2024-01-15"
IN_DAY = f"{TS} >= TIMESTAMP '{DAY}' AND {TS} < TIMESTAMP '2024-01-16'"


@query("daily_log_report", with_staging(f"""
SELECT DATE '{DAY}' AS date, 'error_patterns' AS section, error_type AS entry, COUNT(*) AS figure
FROM logs WHERE level = 'ERROR' AND {IN_DAY} GROUP BY error_type
UNION ALL SELECT DATE '{DAY}', 'performance_metrics', strftime(hour, '%Y-%m-%d %H:%M:%S'), COUNT(response_time)
FROM day_hours LEFT JOIN logs ON date_trunc('hour', {TS}) = hour GROUP BY hour
UNION ALL SELECT DATE '{DAY}', 'user_activity', strftime(hour, '%Y-%m-%d %H:%M:%S'), COUNT(event_type)
FROM day_hours LEFT JOIN logs ON date_trunc('hour', {TS}) = hour GROUP BY hour
UNION ALL SELECT DATE '{DAY}', 'system_health', 'all', COUNT(*) FROM logs WHERE {IN_DAY}""", f"""day_hours AS (
  SELECT unnest(range(TIMESTAMP '{DAY}', TIMESTAMP '2024-01-16', INTERVAL 1 HOUR)) AS hour)"""))
def daily_log_report(t):
    report = logs.daily_log_report(t.logs, DAY)
    names = ["count", "response_time_count", "total_events", "total_requests"]
    figure = F.coalesce(*[F.get_json_object("figures", f"$.{n}").cast("bigint") for n in names])
    return report.select("date", "section", "entry", figure.alias("figure"))


PREDICATES = {
    "error_log_predicate": (logs.is_error_log, "lower(level) LIKE '%error%' OR lower(message) LIKE '%exception%'"),
    "http_error_predicate": (logs.is_http_error, "status_code >= 400"),
    "slow_predicate": (logs.is_slow, "duration_ms >= 1000"),
}


def _predicate(name, condition, sql):
    @query(name, with_staging(f"SELECT {COLUMN_SQL} FROM logs WHERE {sql}"))
    def build(t):
        return flat(t.logs.where(condition()))


for _name, (_condition, _sql) in PREDICATES.items():
    _predicate(_name, _condition, _sql)
