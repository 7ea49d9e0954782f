"""The staging model of ``tallymart.staging`` as SQL for the comparison runs."""

CTES = """
st_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
    o_orderdate AS order_purchase_timestamp,
    o_orderdate + (5 + o_orderkey % 56) * INTERVAL 1 MINUTE AS order_approved_at,
    o_orderdate + (24 + o_orderkey % 49) * INTERVAL 1 HOUR AS order_delivered_carrier_date,
    o_orderdate + (73 + o_orderkey % 500) * INTERVAL 1 HOUR AS order_delivered_customer_date,
    o_orderdate + INTERVAL 15 DAY AS order_estimated_delivery_date
  FROM orders),
st_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
    l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
    CAST(CAST(l_tax AS DECIMAL(10,2)) * 100 AS DECIMAL(10,2)) AS freight_value,
    l_shipdate AS item_delivered_date, CAST(l_discount AS DECIMAL(4,2)) AS discount,
    l_returnflag = 'R' AS is_returned
  FROM lineitem),
st_customers AS (
  SELECT c_custkey AS customer_id, n_name AS customer_city, n_name AS customer_state,
    r_name AS customer_region,
    CASE n_name WHEN 'NATION_0' THEN 'Large' WHEN 'NATION_1' THEN 'Large' WHEN 'NATION_2' THEN 'Large'
      WHEN 'NATION_3' THEN 'Small' ELSE 'Medium' END AS customer_city_size,
    c_mktsegment AS customer_segment, TRUE AS is_current
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
st_sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS seller_city, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
st_products AS (
  SELECT p_partkey AS product_id, p_brand AS product_category_name,
    p_type AS product_category_name_english, p_size AS product_weight_g,
    CAST(10 + p_partkey % 50 AS INT) AS product_length_cm,
    CAST(5 + p_partkey % 20 AS INT) AS product_height_cm,
    CAST(8 + p_partkey % 30 AS INT) AS product_width_cm, TRUE AS is_current
  FROM part),
st_reviews AS (
  SELECT 'r' || o_orderkey AS review_id, o_orderkey AS order_id, o_custkey AS customer_id,
    CAST(1 + o_orderkey % 5 AS INT) AS review_score,
    CASE WHEN o_orderkey % 3 = 0 THEN 'note ' || o_orderkey END AS review_comment_message,
    o_orderdate + INTERVAL 20 DAY AS review_creation_date,
    o_orderdate + (480 + o_orderkey % 97) * INTERVAL 1 HOUR AS review_answer_timestamp
  FROM orders WHERE o_orderkey % 10 >= 2),
st_payments AS (
  SELECT o_orderkey AS order_id, 1 AS payment_sequential,
    CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher'
      ELSE 'debit_card' END AS payment_type,
    CAST(1 + o_orderkey % 12 AS INT) AS payment_installments,
    CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
  FROM orders),
fact_sales AS (
  SELECT i.order_id, i.order_item_id, o.customer_id, i.seller_id, i.product_id,
    CAST(o.order_purchase_timestamp AS DATE) AS order_date,
    o.order_purchase_timestamp AS order_timestamp, o.order_status,
    i.price, i.freight_value, CAST(i.price + i.freight_value AS DECIMAL(13,2)) AS total_amount,
    CAST(floor((epoch_us(i.item_delivered_date) - epoch_us(o.order_estimated_delivery_date))
      / 86400000000.0) AS INT) AS delivery_delay_days,
    CAST(floor((epoch_us(i.item_delivered_date) - epoch_us(o.order_purchase_timestamp))
      / 86400000000.0) AS INT) AS shipping_days,
    i.discount, i.is_returned, r.review_score, p.payment_type, p.payment_installments
  FROM st_items i JOIN st_orders o ON i.order_id = o.order_id
  LEFT JOIN st_reviews r ON r.order_id = o.order_id
  LEFT JOIN st_payments p ON p.order_id = o.order_id),
dim_date AS (
  SELECT date_id, CAST(year(date_id) AS INT) AS year, CAST(month(date_id) AS INT) AS month,
    CAST(day(date_id) AS INT) AS day, CAST(quarter(date_id) AS INT) AS quarter,
    CAST(isodow(date_id) - 1 AS INT) AS day_of_week, dayname(date_id) AS day_name,
    monthname(date_id) AS month_name, isodow(date_id) >= 6 AS is_weekend
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date_id FROM orders)),
logs_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
logs AS (
  SELECT ts AS "timestamp", CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    event_type || ' ' || (k % 7) AS message, 'E' || (k % 5) AS error_type,
    'svc' || (user_id % 3) AS service, '/' || event_type AS endpoint, user_id,
    '10.0.0.' || (user_id % 16) AS ip_address,
    user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, event_type,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
    CAST(value AS DECIMAL(12,2)) AS response_time,
    CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) AS duration_ms,
    256 + k AS memory_usage, k AS cpu_usage, 'q' || (k % 11) AS query_text
  FROM logs_k)
"""


def with_staging(body: str, *more: str) -> str:
    """The query with the staging model, and any further CTEs, in front."""
    return "WITH " + ",\n".join([CTES.strip(), *[m.strip() for m in more]]) + "\n" + body.strip()


def mean(c: str) -> str:
    return f"CAST(SUM({c}) AS DOUBLE) / NULLIF(COUNT({c}), 0)"


def total(c: str) -> str:
    return f"CAST(SUM({c}) AS DOUBLE)"
