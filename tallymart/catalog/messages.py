"""The given tables as the JSON messages that the streaming jobs read.

Text timestamps carry an hour and minute derived from the key, so that hourly
windows differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import Tables


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def customer_messages(events: DataFrame) -> DataFrame:
    """A sign-up event is a new customer."""
    return events.where("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_id").cast("string").alias("customer_unique_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def order_messages(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    bought = F.col("o_orderdate") + (key % 1440) * F.expr("interval 1 minute")
    open_order = F.col("o_orderstatus") == "P"
    delivered = bought + (73 + key % 500) * F.expr("interval 1 hour")
    return orders.select(
        key.cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        iso(bought).alias("order_purchase_timestamp"),
        F.when(~open_order, iso(delivered)).alias("order_delivered_customer_date"),
        iso(bought + F.expr("interval 15 days")).alias("order_estimated_delivery_date"),
    )


def item_messages(lineitem: DataFrame) -> DataFrame:
    """One message per line, stamped with its ship date."""
    shipped = F.col("l_shipdate") + (F.col("l_orderkey") % 24) * F.expr("interval 1 hour")
    item = F.struct(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        iso(F.col("l_shipdate")).alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_tax") * 100).alias("freight_value"),
    )
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        iso(shipped).alias("timestamp"),
        F.array(item).alias("items"),
    )


def payment_messages(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher' ELSE 'debit_card' END").alias("payment_type"),
        F.expr("CAST(1 + o_orderkey % 12 AS INT)").alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"),
        iso(F.col("o_orderdate")).alias("timestamp"),
    )


def review_messages(orders: DataFrame) -> DataFrame:
    written = F.col("o_orderdate") + F.expr("interval 20 days")
    return orders.where("o_orderkey % 10 >= 2").select(
        F.concat(F.lit("r"), "o_orderkey").alias("review_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.expr("CAST(1 + o_orderkey % 5 AS INT)").alias("review_score"),
        iso(written).alias("review_creation_date"),
    )


SOURCES = {
    "customers": ("events", customer_messages),
    "orders": ("orders", order_messages),
    "order_items": ("lineitem", item_messages),
    "payments": ("orders", payment_messages),
    "reviews": ("orders", review_messages),
}


def batch_messages(t: Tables, topic: str) -> DataFrame:
    table, build = SOURCES[topic]
    return build(t.raw(table))


def stream_messages(t: Tables, topic: str) -> DataFrame:
    """The same messages as an unbounded frame over the table's files."""
    table, build = SOURCES[topic]
    return build(t.raw_stream(table))


# The same messages as SQL.
CTES = """
msg_customers AS (SELECT ts FROM events WHERE event_type = 'signup'),
msg_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE AS bought,
    CASE WHEN o_orderstatus <> 'P' THEN date_diff('day',
      o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE + INTERVAL 15 DAY,
      o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE + (73 + o_orderkey % 500) * INTERVAL 1 HOUR)
    END AS delay
  FROM orders),
msg_items AS (
  SELECT l_shipdate + (l_orderkey % 24) * INTERVAL 1 HOUR AS shipped, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    CAST(l_tax * 100 AS DECIMAL(18,2)) AS freight FROM lineitem),
hour_customers AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, COUNT(*) AS count FROM msg_customers GROUP BY 1),
hour_orders AS (
  SELECT time_bucket(INTERVAL 1 HOUR, bought) AS window_start, COUNT(*) AS total_orders,
    CAST(SUM(delay) AS DOUBLE) / NULLIF(COUNT(delay), 0) AS avg_delivery_delay,
    COUNT(DISTINCT customer_id) AS unique_customers FROM msg_orders GROUP BY 1),
hour_sales AS (
  SELECT time_bucket(INTERVAL 1 HOUR, shipped) AS window_start, CAST(SUM(price) AS DOUBLE) AS total_sales,
    CAST(SUM(price) AS DOUBLE) / COUNT(price) AS avg_price, CAST(SUM(freight) AS DOUBLE) AS total_freight,
    COUNT(*) AS total_items FROM msg_items GROUP BY 1)"""
