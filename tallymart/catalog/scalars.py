"""Named queries: scalar helpers and request-style filters on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..streaming.jobs import with_delay
from .registry import query
from .staging_sql import with_staging


@query("format_currency", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('${:,.2f}', abs(c_acctbal)) AS balance,
  CASE WHEN c_acctbal > 0 THEN '-' ELSE '' END || format('€{:,.2f}', abs(c_acctbal)) AS debit FROM customer""")
def format_currency(t):
    return t.raw("customer").select(
        "c_custkey",
        text.format_currency("c_acctbal").alias("balance"),
        text.format_currency(-F.col("c_acctbal"), "€").alias("debit"),
    )


@query("percentage_change", "SELECT o_orderkey, round((o_totalprice - 700) / 700 * 100, 2) AS change, "
       "CAST('inf' AS DOUBLE) AS from_zero FROM orders")
def percentage_change(t):
    return t.raw("orders").select(
        "o_orderkey",
        text.percentage_change(F.lit(700.0), F.col("o_totalprice")).alias("change"),
        text.percentage_change(F.lit(0.0), F.col("o_totalprice")).alias("from_zero"),
    )


@query("mask_sensitive", """
SELECT c_custkey, substr(lower(replace(c_name, '#', '.')) || '@example.com', 1, 3) || '***om' AS email,
  '********' AS password, repeat('*', length(c_name) - 4) || right(c_name, 4) AS credit_card FROM customer""")
def mask_sensitive(t):
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return text.mask_sensitive(
        t.raw("customer").select(
            "c_custkey", mail.alias("email"), F.col("c_name").alias("password"), F.col("c_name").alias("credit_card")
        )
    )


@query("is_valid_email", """
SELECT c_custkey, c_mktsegment <> 'MACHINERY' AS complete, c_mktsegment = 'BUILDING' AS dotted FROM customer""")
def is_valid_email(t):
    segment = F.col("c_mktsegment")
    name = F.replace("c_name", F.lit("#"), F.lit("."))
    host = F.when(segment == "MACHINERY", "@").otherwise("@example.co.uk")
    dots = F.when(segment == "BUILDING", "@shop.example.com").otherwise("@.com")
    return t.raw("customer").select(
        "c_custkey",
        text.is_valid_email(F.concat(name, host)).alias("complete"),
        text.is_valid_email(F.concat(name, dots)).alias("dotted"),
    )


@query("parse_date", """
SELECT o_orderkey, o_orderdate AS from_date, o_orderdate AS from_time, CAST(NULL AS TIMESTAMP) AS from_other,
  strftime(o_orderdate, '%Y-%m-%d') AS text_date FROM orders""")
def parse_date(t):
    return t.raw("orders").select(
        "o_orderkey",
        dates.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("from_date"),
        dates.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("from_time"),
        dates.parse_date(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("from_other"),
        dates.format_date("o_orderdate").alias("text_date"),
    )


@query("previous_period", """
SELECT o_orderkey, o_orderdate - INTERVAL 1 DAY AS day, o_orderdate - INTERVAL 7 DAY AS week,
  o_orderdate - INTERVAL 1 MONTH AS month, o_orderdate - INTERVAL 1 YEAR AS year FROM orders""")
def previous_period(t):
    ts = F.col("o_orderdate").cast("timestamp")
    return t.raw("orders").select(
        "o_orderkey", *[dates.previous_period(ts, p).alias(p) for p in dates.PREVIOUS_PERIOD]
    )


@query("days_between", with_staging("""
SELECT order_id, CAST(date_diff('day', order_estimated_delivery_date, order_delivered_customer_date) AS INT) AS calendar,
  CAST(floor((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date))
    / 86400000000.0) AS INT) AS floored,
  CAST(date_sub('day', order_estimated_delivery_date, order_delivered_customer_date) AS INT) AS truncated
FROM st_orders"""))
def days_between(t):
    late, due = "order_delivered_customer_date", "order_estimated_delivery_date"
    return t.orders.select(
        "order_id",
        dates.calendar_days(late, due).alias("calendar"),
        dates.elapsed_days_floor(late, due).alias("floored"),
        dates.elapsed_days_trunc(F.col(late), F.col(due)).alias("truncated"),
    )


@query("entry_key", """
SELECT o_orderkey, 'order:' || o_orderkey || ':' || o_orderstatus AS key,
  'query:' || sha256(o_orderkey || ':' || o_orderpriority) AS query_key FROM orders""")
def entry_key(t):
    return t.raw("orders").select(
        "o_orderkey",
        text.entry_key("order", "o_orderkey", "o_orderstatus").alias("key"),
        text.query_key("o_orderkey", "o_orderpriority").alias("query_key"),
    )


@query("uuid_key", """
SELECT event_id, regexp_replace(md5(event_id || chr(31) || event_type || chr(31) || coalesce(CAST(nullif(user_id % 3, 0) AS VARCHAR), chr(0))),
  '^(.{8})(.{4})(.{4})(.{4})', '\\1-\\2-\\3-\\4-') AS key FROM events""")
def uuid_key(t):
    third = F.nullif(F.col("user_id") % 3, F.lit(0))
    return t.raw("events").select("event_id", text.uuid_key("event_id", "event_type", third).alias("key"))


@query("date_range", """
SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS orders FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1996-02-29 12:00:00' GROUP BY 1""")
def date_range(t):
    """Orders between two bounds that were parsed and checked; a range that ends before it starts is refused."""
    first, last = dates.date_range("1995-03-01", "1996-02-29T12:00:00")
    try:
        dates.date_range("1996-02-29", "1995-03-01")
    except ValueError:
        orders = t.raw("orders").where(F.col("o_orderdate").between(F.lit(first), F.lit(last)))
        return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    raise ValueError("a range that ends before it starts was taken")


@query("api_filter", with_staging("""
SELECT product_id, product_category_name, product_weight_g FROM st_products
WHERE product_weight_g >= 10 AND product_weight_g <= 40 AND product_category_name LIKE 'Brand#1%'
  AND product_category_name_english IN ('ECONOMY', 'PROMO')"""))
def api_filter(t):
    params = {
        "product_weight_g_min": "10",
        "product_weight_g_max": "40",
        "product_category_name_like": "Brand#1%",
        "product_category_name_english": "ECONOMY,PROMO",
    }
    return text.api_filter(t.products, params).select("product_id", "product_category_name", "product_weight_g")


@query("optional_date_filter", with_staging(
    "SELECT order_id FROM st_orders WHERE order_purchase_timestamp >= TIMESTAMP '1996-01-01'"))
def optional_date_filter(t):
    return dates.optional_date_filter(t.orders, "order_purchase_timestamp", start="1996-01-01").select("order_id")


@query("paginate", with_staging(
    "SELECT order_id, customer_id FROM st_orders ORDER BY order_id LIMIT 100 OFFSET 100"))
def paginate(t):
    return text.paginate(t.orders, ["order_id"], page=2, per_page=100).select("order_id", "customer_id")


@query("page_totals", "SELECT COUNT(*) AS total_count, 100 AS per_page, "
       "CAST(ceil(COUNT(*) / 100) AS BIGINT) AS total_pages FROM orders")
def page_totals(t):
    return text.page_totals(t.orders, 100)


@query("sort_by", with_staging("SELECT order_id, payment_value FROM (SELECT order_id, CAST(payment_value AS DOUBLE) "
       "AS payment_value FROM st_payments) ORDER BY payment_value DESC, order_id"))
def sort_by(t):
    rows = t.order_payments.select("order_id", F.col("payment_value").cast("double").alias("payment_value"))
    return text.sort_by(rows, "payment_value", "desc", "order_id")


@query("lookback", with_staging(
    "SELECT order_id FROM st_orders WHERE order_purchase_timestamp >= DATE '2001-08-02' - INTERVAL 365 DAY"))
def lookback(t):
    return dates.lookback(t.orders, "order_purchase_timestamp", 365, "2001-08-02").select("order_id")


@query("between_dates", with_staging("SELECT order_id FROM st_orders WHERE order_purchase_timestamp "
       "BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31'"))
def between_dates(t):
    return dates.between_dates(t.orders, "order_purchase_timestamp", "1995-01-01", "2001-12-31").select("order_id")


@query("delivery_delay", with_staging("""
SELECT order_id, CAST(date_diff('day', order_estimated_delivery_date, order_delivered_customer_date) AS INT)
  AS delivery_delay FROM st_orders"""))
def delivery_delay(t):
    texts = {c: F.col(c).cast("string") for c in ("order_delivered_customer_date", "order_estimated_delivery_date")}
    return with_delay(t.orders.withColumns(texts)).select("order_id", "delivery_delay")
