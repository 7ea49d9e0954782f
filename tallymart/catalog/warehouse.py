"""Named queries: dimensions, facts, order views, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import quality, warehouse
from .registry import query, rounded
from .staging_sql import mean, total, with_staging


@query("date_dimension", with_staging("SELECT * FROM dim_date"))
def date_dimension(t):
    return t.dim_date


@query("customer_dimension", with_staging("""
SELECT customer_id, customer_city, customer_state, customer_segment,
  CASE customer_city WHEN 'NATION_1' THEN 'Large' WHEN 'NATION_2' THEN 'Small' ELSE 'Medium' END AS customer_city_size,
  CASE customer_state WHEN 'NATION_1' THEN 'North' WHEN 'NATION_3' THEN 'South' ELSE 'Other' END AS customer_region
FROM st_customers"""))
def customer_dimension(t):
    source = t.customers.select("customer_id", "customer_city", "customer_state", "customer_segment")
    return warehouse.customer_dimension(
        source, {"NATION_1": "Large", "NATION_2": "Small"}, {"NATION_1": "North", "NATION_3": "South"}
    )


@query("product_dimension", with_staging("""
SELECT product_id, v AS product_volume_cm3,
  CASE WHEN v <= v1 THEN 'Small' WHEN v <= v2 THEN 'Medium' ELSE 'Large' END AS product_size_category,
  CASE WHEN w <= w1 THEN 'Light' WHEN w <= w2 THEN 'Medium' ELSE 'Heavy' END AS product_weight_category
FROM sized, (SELECT quantile_cont(v, CAST(1 AS DOUBLE) / 3) AS v1, quantile_cont(v, CAST(2 AS DOUBLE) / 3) AS v2,
  quantile_cont(w, CAST(1 AS DOUBLE) / 3) AS w1, quantile_cont(w, CAST(2 AS DOUBLE) / 3) AS w2 FROM sized)""",
    """sized AS (SELECT product_id, product_length_cm * product_height_cm * product_width_cm AS v,
  product_weight_g AS w FROM st_products)"""))
def product_dimension(t):
    return warehouse.product_dimension(t.products).select(
        "product_id", "product_volume_cm3", "product_size_category", "product_weight_category"
    )


FACT = ("order_id, order_item_id, customer_id, seller_id, product_id, order_date, order_timestamp, order_status, "
        "CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value, "
        "CAST(total_amount AS DOUBLE) AS total_amount, delivery_delay_days, shipping_days, review_score, "
        "payment_type, payment_installments")


@query("sales_fact", with_staging(f"SELECT {FACT} FROM fact_sales"))
def sales_fact(t):
    fact = t.fact_sales(reviews=True, payments=True).drop("discount", "is_returned")
    return fact.withColumns({c: F.col(c).cast("double") for c in ("price", "freight_value", "total_amount")})


@query("order_summary", with_staging(f"""
SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
  COUNT(DISTINCT i.product_id) AS total_items, {total('i.price')} AS total_amount,
  {total('i.freight_value')} AS total_freight, MAX(p.payment_type) AS payment_type,
  MAX(p.payment_installments) AS payment_installments, MAX(r.review_score) AS review_score
FROM st_orders o LEFT JOIN st_items i ON o.order_id = i.order_id
LEFT JOIN st_payments p ON o.order_id = p.order_id LEFT JOIN st_reviews r ON o.order_id = r.order_id
GROUP BY 1, 2, 3, 4"""))
def order_summary(t):
    return warehouse.order_summary(t.orders, t.order_items, t.order_payments, t.order_reviews)


def _best(key: str, name: str) -> str:
    return f"""best AS (
  SELECT {key}, order_date, product_category_name AS {name} FROM (
    SELECT {key}, order_date, product_category_name, row_number() OVER (
      PARTITION BY {key}, order_date ORDER BY COUNT(*) DESC, product_category_name DESC) AS rn
    FROM fact_sales f JOIN st_products p ON f.product_id = p.product_id
    GROUP BY {key}, order_date, product_category_name) WHERE rn = 1)"""


def _day_metrics(key: str, amount: str, name: str, more: str = "") -> str:
    return with_staging(f"""
SELECT m.*, b.{name} FROM (
  SELECT {key}, order_date AS date_id, COUNT(DISTINCT order_id) AS orders_count, {total('total_amount')} AS {amount},
    CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT order_id) AS average_order_value,
    COUNT(*) AS total_items, COUNT(DISTINCT product_id) AS unique_products,
    {mean('review_score')} AS review_score_avg{more}
  FROM fact_sales GROUP BY 1, 2) m
LEFT JOIN best b ON m.{key} = b.{key} AND m.date_id = b.order_date""", _best(key, name))


@query("fact_customer_metrics", _day_metrics("customer_id", "total_amount", "favorite_category"))
def fact_customer_metrics(t):
    return warehouse.fact_customer_metrics(t.fact_sales(reviews=True), t.products)


@query("fact_seller_metrics", _day_metrics(
    "seller_id", "total_revenue", "top_category", f", {mean('delivery_delay_days')} AS delivery_delay_avg"))
def fact_seller_metrics(t):
    return warehouse.fact_seller_metrics(t.fact_sales(reviews=True), t.products)


@query("fact_product_metrics", with_staging(f"""
SELECT product_id, order_date AS date_id, COUNT(DISTINCT order_id) AS orders_count,
  {total('total_amount')} AS total_revenue, {mean('price')} AS average_price, COUNT(*) AS total_quantity,
  {mean('review_score')} AS review_score_avg
FROM fact_sales GROUP BY 1, 2"""))
def fact_product_metrics(t):
    return warehouse.fact_product_metrics(t.fact_sales(reviews=True))


@query("fact_customer_satisfaction", with_staging("""
SELECT review_id, order_id, customer_id, CAST(review_creation_date AS DATE) AS review_date, review_score,
  CASE WHEN review_comment_message IS NOT NULL THEN 1 ELSE 0 END AS has_review_comment,
  date_diff('second', review_creation_date, review_answer_timestamp) / 3600 AS review_response_time_hours
FROM st_reviews"""))
def fact_customer_satisfaction(t):
    return warehouse.fact_customer_satisfaction(t.order_reviews)


@query("denormalize_order", with_staging("""
SELECT o.order_id, CAST(coalesce(floor((i.order_item_id - 1) / 100), 0) AS INT) AS page, o.order_status, c.customer_city, p.payment_type, r.review_score,
  COUNT(i.order_id) AS lines, CAST(SUM(i.price) AS DOUBLE) AS price, MIN(i.order_item_id) AS first_item
FROM st_orders o LEFT JOIN st_customers c ON o.customer_id = c.customer_id
LEFT JOIN st_payments p ON o.order_id = p.order_id LEFT JOIN st_reviews r ON o.order_id = r.order_id
LEFT JOIN st_items i ON o.order_id = i.order_id GROUP BY 1, 2, 3, 4, 5, 6"""))
def denormalize_order(t):
    docs = warehouse.denormalize_order(
        t.orders, t.order_items, t.order_payments, t.order_reviews, t.customers
    )
    zero = F.lit(0).cast("decimal(22,2)")
    price = F.aggregate("items.price", zero, lambda a, x: (a + x).cast("decimal(22,2)"))
    return docs.select(
        "order_id",
        "page",
        "order.order_status",
        "customer.customer_city",
        "payment.payment_type",
        "review.review_score",
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("lines"),
        F.when(F.col("items").isNotNull(), price).cast("double").alias("price"),
        F.array_min("items.order_item_id").alias("first_item"),
    )


@query("active_orders", with_staging(
    "SELECT order_id, order_status FROM st_orders WHERE order_status NOT IN ('delivered', 'canceled')"))
def active_orders(t):
    return warehouse.active_orders(t.orders).select("order_id", "order_status")


@query("current_rows", with_staging("SELECT product_id, product_category_name FROM st_products WHERE is_current"))
def current_rows(t):
    return warehouse.current_rows(t.products).select("product_id", "product_category_name")


@query("referential_violations", with_staging("""
SELECT order_id, customer_id FROM st_orders o
WHERE NOT EXISTS (SELECT 1 FROM st_items i WHERE i.order_id = o.order_id)"""))
def referential_violations(t):
    return quality.referential_violations(t.orders, "order_id", t.order_items).select("order_id", "customer_id")


def _rule(table, rule, source, ok):
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, COUNT(*) AS checked, "
            f"CAST(SUM(CASE WHEN {ok} THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM {source}")


def _unique(table, keys, source):
    return (f"SELECT '{table}', 'unique {keys}', CAST(SUM(n) AS BIGINT), CAST(SUM(n - 1) AS BIGINT) "
            f"FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY {keys})")


def _known(table, key, source, parent):
    return (f"SELECT '{table}', 'known {key}', COUNT(*), "
            f"CAST(SUM(CASE WHEN {key} IN (SELECT {key} FROM {parent}) THEN 0 ELSE 1 END) AS BIGINT) FROM {source}")


QUALITY = "\nUNION ALL ".join([
    _rule("orders", "order_id present", "st_orders", "order_id IS NOT NULL"),
    _rule("orders", "customer_id present", "st_orders", "customer_id IS NOT NULL"),
    _rule("orders", "order_status known", "st_orders",
          "order_status IN ('created','approved','processing','shipped','delivered','canceled','unavailable')"),
    _rule("orders", "approved after purchase", "st_orders", "order_approved_at >= order_purchase_timestamp"),
    _rule("orders", "carrier after approval", "st_orders", "order_delivered_carrier_date >= order_approved_at"),
    _rule("orders", "delivered after carrier", "st_orders",
          "order_delivered_customer_date >= order_delivered_carrier_date"),
    _rule("order_items", "price present", "st_items", "price IS NOT NULL"),
    _rule("order_items", "price in 10..1000", "st_items", "price BETWEEN 10 AND 1000"),
    _rule("order_items", "freight in 5..50", "st_items", "freight_value BETWEEN 5 AND 50"),
    _rule("order_payments", "payment_type known", "st_payments",
          "payment_type IN ('credit_card','boleto','voucher','debit_card')"),
    _rule("order_reviews", "score in 1..5", "st_reviews", "review_score BETWEEN 1 AND 5"),
    _unique("orders", "order_id", "st_orders"),
    _unique("order_items", "order_id, order_item_id", "st_items"),
    _known("orders", "customer_id", "st_orders", "st_customers"),
    _known("order_items", "order_id", "st_items", "st_orders"),
    _known("order_items", "product_id", "st_items", "st_products"),
    _known("order_items", "seller_id", "st_items", "st_sellers"),
    _known("order_reviews", "order_id", "st_reviews", "st_orders"),
])


@query("data_quality_report", with_staging(QUALITY))
def data_quality_report(t):
    return quality.data_quality_report(
        t.customers, t.orders, t.order_items, t.products, t.sellers, t.order_payments, t.order_reviews
    )


_HOURS = """stages AS (
  SELECT order_status, date_diff('second', order_purchase_timestamp, order_approved_at) / 3600 AS approval,
    date_diff('second', order_approved_at, order_delivered_carrier_date) / 3600 AS handling,
    date_diff('second', order_delivered_carrier_date, order_delivered_customer_date) / 3600 AS transit,
    date_diff('second', order_purchase_timestamp, order_delivered_customer_date) / 3600 AS total
  FROM st_orders)"""


@query("order_processing_stages", with_staging("""
SELECT order_status, COUNT(*) AS orders, round(AVG(approval), 6) AS avg_approval_hours,
  round(AVG(handling), 6) AS avg_handling_hours, round(AVG(transit), 6) AS avg_transit_hours,
  round(AVG(total), 6) AS avg_total_hours
FROM stages GROUP BY 1""", _HOURS))
def order_processing_stages(t):
    names = [f"avg_{s}_hours" for s in quality.STAGES]
    return rounded(quality.order_processing_stages(t.orders), *names, digits=6)


@query("delivery_time_analysis", with_staging("\nUNION ALL ".join(
    f"SELECT '{s}' AS stage, round(quantile_cont({s}, 0.5), 6) AS median_hours, "
    f"round(quantile_cont({s}, 0.9), 6) AS p90_hours, round(quantile_cont({s}, 0.95), 6) AS p95_hours FROM stages"
    for s in quality.STAGES), _HOURS))
def delivery_time_analysis(t):
    return rounded(quality.delivery_time_analysis(t.orders), "median_hours", "p90_hours", "p95_hours", digits=6)


FAR = "TIMESTAMP '9999-12-31'"


# What was known of each customer and when: seen at first, again unchanged, changed in between for some, and last of all.
OBSERVED = """seen AS (
  SELECT customer_id, customer_segment AS segment, TIMESTAMP '1992-06-01' AS observed_at FROM st_customers WHERE customer_id % 11 <> 5
  UNION ALL SELECT customer_id, customer_segment, TIMESTAMP '1996-01-01' FROM st_customers
  UNION ALL SELECT customer_id, 'SPLIT', TIMESTAMP '1994-03-15 12:00:00' FROM st_customers WHERE customer_id % 3 = 0
  UNION ALL SELECT customer_id, 'LAST', TIMESTAMP '1997-09-09' FROM st_customers WHERE customer_id % 5 = 1),
changes AS (SELECT *, lag(segment) OVER (PARTITION BY customer_id ORDER BY observed_at) AS before FROM seen),
versions AS (
  SELECT customer_id, segment, observed_at AS valid_from, coalesce(lead(observed_at) OVER (PARTITION BY customer_id ORDER BY observed_at),
    TIMESTAMP '9999-12-31') AS valid_to FROM changes WHERE before IS DISTINCT FROM segment)"""


def _observed(t):
    at = lambda text: F.lit(text).cast("timestamp").alias("observed_at")
    who, as_is = F.col("customer_id"), F.col("customer_segment").alias("segment")
    return [
        t.customers.where(who % 11 != 5).select(who, as_is, at("1992-06-01")),
        t.customers.select(who, as_is, at("1996-01-01")),
        t.customers.where(who % 5 == 1).select(who, F.lit("LAST").alias("segment"), at("1997-09-09")),
        t.customers.where(who % 3 == 0).select(who, F.lit("SPLIT").alias("segment"), at("1994-03-15 12:00:00")),
    ]


def _history(t):
    """The first three observations, then the one that comes late."""
    *first, late = _observed(t)
    known = reduce(lambda a, b: a.unionByName(b), first)
    history = warehouse.scd2_history(known, "customer_id", ["segment"])
    return warehouse.scd2_late(history, known.unionByName(late), late, "customer_id", ["segment"])


@query("scd2_late", with_staging("SELECT customer_id, segment, valid_from, valid_from = max(valid_from) OVER (PARTITION BY customer_id) AS is_current FROM versions", OBSERVED))
def scd2_late(t):
    return _history(t).drop("valid_to")


@query("at_its_time", with_staging("""
SELECT f.order_id, f.order_item_id, v.segment FROM fact_sales f
LEFT JOIN versions v ON v.customer_id = f.customer_id AND f.order_timestamp >= v.valid_from AND f.order_timestamp < v.valid_to""", OBSERVED))
def at_its_time(t):
    facts = t.fact_sales().select("order_id", "order_item_id", "customer_id", "order_timestamp")
    return warehouse.at_its_time(facts, _history(t), "customer_id", "order_timestamp", ["segment"]).drop("customer_id", "order_timestamp")


@query("scd2_merge", with_staging(f"""
SELECT customer_id, customer_city, customer_segment, TIMESTAMP '2000-01-01' AS valid_from,
  CASE WHEN changed THEN TIMESTAMP '2001-01-01' ELSE {FAR} END AS valid_to, NOT changed AS is_current
FROM (SELECT *, customer_region = 'ASIA' AS changed FROM st_customers)
UNION ALL
SELECT customer_id, customer_city, customer_segment || ' PLUS', TIMESTAMP '2001-01-01', {FAR}, TRUE
FROM st_customers WHERE customer_region = 'ASIA'"""))
def scd2_merge(t):
    cols = ["customer_city", "customer_segment"]
    first = warehouse.scd2_open(t.customers.select("customer_id", *cols), "2000-01-01")
    moved = F.when(
        F.col("customer_region") == "ASIA", F.concat("customer_segment", F.lit(" PLUS"))
    ).otherwise(F.col("customer_segment"))
    snapshot = t.customers.select("customer_id", "customer_city", moved.alias("customer_segment"))
    return warehouse.scd2_merge(first, snapshot, "customer_id", cols, "2001-01-01")
