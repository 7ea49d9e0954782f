"""Explicit schemas of messages, CSV extracts and logs, and fixed value lists."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "money": T.DecimalType(12, 2),
    "bigint": T.LongType(),
    "datetime": T.TimestampNTZType(),
}


def _struct(text: str) -> T.StructType:
    """``name type, name type`` as a schema; all fields may be null."""
    fields = [f.split() for f in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


# The given Parquet tables.
GIVEN_TABLES = {
    "region": _struct("r_regionkey int, r_name string"),
    "nation": _struct("n_nationkey int, n_name string, n_regionkey int"),
    "customer": _struct(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": _struct("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": _struct(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": _struct(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate datetime, o_orderpriority string"
    ),
    "lineitem": _struct(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate datetime"
    ),
    "events": _struct(
        "event_id bigint, ts datetime, user_id bigint, event_type string, value double, props string"
    ),
}

# Order states, payment kinds, topics and severities.
ORDER_STATUS = ["created", "approved", "processing", "shipped", "delivered", "canceled", "unavailable"]
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card"]
TOPICS = ["customers", "orders", "order_items", "payments", "reviews"]
SEVERITIES = ["ERROR", "WARN", "INFO"]
METRIC_NAME_PATTERN = "duration|request|error|active"

# Days that each kind of log is kept.
RETENTION_DAYS = {
    "system_logs": 90,
    "application_logs": 90,
    "performance_logs": 90,
    "access_logs": 180,
    "error_logs": 180,
    "audit_logs": 365,
    "indexed_logs": 30,
}

# City sizes and state regions of the customer dimension.
CITY_SIZES = {"Sao Paulo": "Large", "Rio de Janeiro": "Large", "Brasilia": "Large"}
STATE_REGIONS = {"SP": "Southeast", "RJ": "Southeast", "MG": "Southeast"}

CUSTOMER_MESSAGE = _struct(
    "customer_id string, customer_unique_id string, customer_zip_code string, "
    "customer_city string, customer_state string, timestamp string"
)
ORDER_MESSAGE = _struct(
    "order_id string, customer_id string, order_status string, order_purchase_timestamp string, "
    "order_approved_at string, order_delivered_carrier_date string, "
    "order_delivered_customer_date string, order_estimated_delivery_date string"
)
ITEM = _struct(
    "order_id string, order_item_id int, product_id string, seller_id string, "
    "shipping_limit_date string, price double, freight_value double"
)
ITEMS_MESSAGE = _struct("order_id string, timestamp string").add("items", T.ArrayType(ITEM))
PAYMENT_MESSAGE = _struct(
    "order_id string, payment_sequential int, payment_type string, "
    "payment_installments int, payment_value double, timestamp string"
)
REVIEW_MESSAGE = _struct(
    "review_id string, order_id string, review_score int, review_comment_title string, "
    "review_comment_message string, review_creation_date string, review_answer_timestamp string"
)
MESSAGES = {
    "customers": CUSTOMER_MESSAGE,
    "orders": ORDER_MESSAGE,
    "order_items": ITEMS_MESSAGE,
    "payments": PAYMENT_MESSAGE,
    "reviews": REVIEW_MESSAGE,
}

CUSTOMERS_CSV = _struct(
    "customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
    "customer_city string, customer_state string"
)
ORDERS_CSV = _struct(
    "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, "
    "order_approved_at timestamp, order_delivered_carrier_date timestamp, "
    "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp"
)
ITEMS_CSV = _struct(
    "order_id string, order_item_id int, product_id string, seller_id string, "
    "shipping_limit_date timestamp, price money, freight_value money"
)
PRODUCTS_CSV = _struct(
    "product_id string, product_category_name string, product_name_lenght int, "
    "product_description_lenght int, product_photos_qty int, product_weight_g int, "
    "product_length_cm int, product_height_cm int, product_width_cm int"
)
SELLERS_CSV = _struct(
    "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string"
)
TRANSLATION_CSV = _struct("product_category_name string, product_category_name_english string")
# Extracts by short name: file name and schema.
CSV_FILES = {
    "customers": ("customers.csv", CUSTOMERS_CSV),
    "orders": ("orders.csv", ORDERS_CSV),
    "order_items": ("order_items.csv", ITEMS_CSV),
    "products": ("products.csv", PRODUCTS_CSV),
    "sellers": ("sellers.csv", SELLERS_CSV),
    "category_translation": ("category_translation.csv", TRANSLATION_CSV),
}

# JSON-lines logs as written by the web server and by the application.
ACCESS_LOG = _struct(
    "time_local string, remote_addr string, remote_user string, request string, status string, "
    "body_bytes_sent string, request_time string, http_referrer string, http_user_agent string, "
    "request_id string, trace_id string"
)
APPLICATION_LOG = _struct(
    "timestamp string, level string, logger string, message string, trace_id string, span_id string"
)
