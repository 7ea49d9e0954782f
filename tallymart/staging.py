"""The given tables as the canonical commerce model.

Columns the given tables lack (order stages, reviews, payments, product sizes)
are stand-ins derived from the keys, written the same way in
``catalog.staging_sql`` for the comparison queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import lookup
from .operators import warehouse
from .schemas import GIVEN_TABLES
from .session import bound_tasks

# The given tables hold timestamps without a zone.
BOUGHT = "CAST(o_orderdate AS TIMESTAMP)"

# City sizes used with the given nation names.
NATION_SIZES = {"NATION_0": "Large", "NATION_1": "Large", "NATION_2": "Large", "NATION_3": "Small"}


class Tables:
    """Lazy staging frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = bound_tasks(spark)
        self.sf_dir = str(sf_dir).rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            reader = self.spark.read.schema(GIVEN_TABLES[name])
            self._raw[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def raw_stream(self, name: str) -> DataFrame:
        """A given table as an unbounded frame; the glob fits a file or a folder."""
        reader = self.spark.readStream.schema(GIVEN_TABLES[name])
        return reader.parquet(f"{self.sf_dir}/{name}.parquet*")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status",
            f"{BOUGHT} AS order_purchase_timestamp",
            f"{BOUGHT} + (5 + o_orderkey % 56) * INTERVAL 1 MINUTE AS order_approved_at",
            f"{BOUGHT} + (24 + o_orderkey % 49) * INTERVAL 1 HOUR AS order_delivered_carrier_date",
            f"{BOUGHT} + (73 + o_orderkey % 500) * INTERVAL 1 HOUR AS order_delivered_customer_date",
            f"{BOUGHT} + INTERVAL 15 DAY AS order_estimated_delivery_date",
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_linenumber AS order_item_id",
            "l_partkey AS product_id",
            "l_suppkey AS seller_id",
            "CAST(l_extendedprice AS DECIMAL(12,2)) AS price",
            "CAST(l_tax * 100 AS DECIMAL(10,2)) AS freight_value",
            "CAST(l_shipdate AS TIMESTAMP) AS item_delivered_date",
            "CAST(l_discount AS DECIMAL(4,2)) AS discount",
            "l_returnflag = 'R' AS is_returned",
        )

    @cached_property
    def customers(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("n_name").alias("customer_city"),
                F.col("n_name").alias("customer_state"),
                F.col("r_name").alias("customer_region"),
                lookup(F.col("n_name"), NATION_SIZES, "Medium").alias("customer_city_size"),
                F.col("c_mktsegment").alias("customer_segment"),
                F.lit(True).alias("is_current"),
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                F.col("n_name").alias("seller_city"),
                F.col("n_name").alias("seller_state"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS product_id",
            "p_brand AS product_category_name",
            "p_type AS product_category_name_english",
            "p_size AS product_weight_g",
            "CAST(10 + p_partkey % 50 AS INT) AS product_length_cm",
            "CAST(5 + p_partkey % 20 AS INT) AS product_height_cm",
            "CAST(8 + p_partkey % 30 AS INT) AS product_width_cm",
            "TRUE AS is_current",
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        return (
            self.raw("orders")
            .where("o_orderkey % 10 >= 2")
            .selectExpr(
                "concat('r', o_orderkey) AS review_id",
                "o_orderkey AS order_id",
                "o_custkey AS customer_id",
                "CAST(1 + o_orderkey % 5 AS INT) AS review_score",
                "CASE WHEN o_orderkey % 3 = 0 THEN concat('note ', o_orderkey) END AS review_comment_message",
                f"{BOUGHT} + INTERVAL 20 DAY AS review_creation_date",
                f"{BOUGHT} + (480 + o_orderkey % 97) * INTERVAL 1 HOUR AS review_answer_timestamp",
            )
        )

    @cached_property
    def order_payments(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS order_id",
            "1 AS payment_sequential",
            "CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher' "
            "ELSE 'debit_card' END AS payment_type",
            "CAST(1 + o_orderkey % 12 AS INT) AS payment_installments",
            "CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value",
        )

    def fact_sales(self, reviews: bool = False, payments: bool = False) -> DataFrame:
        """The sales fact; reviews and payments are joined only on request."""
        return warehouse.sales_fact(
            self.orders,
            self.order_items,
            reviews=self.order_reviews if reviews else None,
            payments=self.order_payments if payments else None,
            delivered="item_delivered_date",
        )

    @cached_property
    def dim_date(self) -> DataFrame:
        return warehouse.date_dimension(self.orders, "order_purchase_timestamp")

    @cached_property
    def logs(self) -> DataFrame:
        return self._log_rows(self.raw("events"))

    def stream_logs(self) -> DataFrame:
        """The log rows as an unbounded frame over the files of the events."""
        return self._log_rows(self.raw_stream("events"))

    @staticmethod
    def _log_rows(events: DataFrame) -> DataFrame:
        return events.selectExpr(
            "*", "CAST(get_json_object(props, '$.k') AS INT) AS k", "CAST(value AS DECIMAL(12,2)) AS v"
        ).selectExpr(
            "CAST(ts AS TIMESTAMP) AS timestamp",
            "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level",
            "concat(event_type, ' ', k % 7) AS message",
            "concat('E', k % 5) AS error_type",
            "concat('svc', user_id % 3) AS service",
            "concat('/', event_type) AS endpoint",
            "user_id",
            "concat('10.0.0.', user_id % 16) AS ip_address",
            "concat(user_id, '-', date_format(ts, 'yyyy-MM-dd')) AS session_id",
            "event_type",
            "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code",
            "v AS response_time",
            "CAST(v * 100 AS BIGINT) AS duration_ms",
            "256 + k AS memory_usage",
            "k AS cpu_usage",
            "concat('q', k % 11) AS query_text",
        )
