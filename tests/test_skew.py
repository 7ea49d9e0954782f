"""A hot order that holds a third of all lines is split, with the same result."""

import pytest
from pyspark.sql import functions as F

from tallymart.functions.skew import join_on_key
from tallymart.operators import products, warehouse

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "24",
}


@pytest.fixture
def small_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture
def shop(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000)
    cents = F.pmod(F.xxhash64("id"), F.lit(10_000))
    items = spark.range(0, 120_000, 1, 24).select(
        key.alias("order_id"),
        F.col("id").alias("order_item_id"),
        (F.pmod(F.hash("id"), F.lit(400))).alias("product_id"),
        F.lit(1).alias("seller_id"),
        (cents / 100).cast("decimal(12,2)").alias("price"),
        (cents / 1000).cast("decimal(12,2)").alias("freight_value"),
    )
    orders = spark.range(5000).select(
        F.col("id").alias("order_id"),
        (F.col("id") % 50).alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.lit("2024-01-01").cast("timestamp").alias("order_purchase_timestamp"),
        F.lit("2024-01-09").cast("timestamp").alias("order_delivered_customer_date"),
        F.lit("2024-01-08").cast("timestamp").alias("order_estimated_delivery_date"),
    )
    reviews = orders.select("order_id", (F.col("order_id") % 5 + 1).cast("int").alias("review_score"))
    dim = spark.range(400).select(
        F.col("id").alias("product_id"), F.concat(F.lit("c"), F.col("id") % 7).alias("product_category_name")
    )
    return orders, items, reviews, dim


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_fact_with_reviews_splits_the_hot_order(small_thresholds, shop):
    orders, items, reviews, _ = shop
    rows, plan = final_plan(warehouse.sales_fact(orders, items, reviews=reviews))
    assert "skew=true" in plan
    assert len(rows) == 120_000 and len({r.order_item_id for r in rows}) == 120_000


def test_performance_with_a_hot_order(small_thresholds, shop):
    orders, items, reviews, dim = shop
    rows, plan = final_plan(products.product_performance(orders, items, dim, reviews))
    assert "skew=true" in plan
    want = {
        r.c: (r.n, float(r.s))
        for r in items.join(dim, "product_id")
        .groupBy(F.col("product_category_name").alias("c"))
        .agg(F.countDistinct("order_id").alias("n"), F.sum("price").alias("s"))
        .collect()
    }
    assert {r.product_category_name: (r.total_orders, r.total_revenue) for r in rows} == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_on_key_is_a_plain_join(rows, how):
    many = rows("k int, v int", (1, 1), (1, 2), (2, 3), (None, 4))
    one = rows("k int", (1,), (9,))
    got = sorted(map(str, join_on_key(many, one, "k", how).collect()))
    assert got == sorted(map(str, many.join(one, "k", how).collect()))


def test_tables_bound_what_a_task_reads(spark):
    from tallymart.session import SHUFFLE_PARTS, SPLIT_BYTES
    from tallymart.staging import Tables

    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    keys = [*SPLIT_BYTES, parts]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in SPLIT_BYTES:
            spark.conf.set(k, "128MB")
        spark.conf.unset(parts)
        Tables(spark, "/nowhere")
        assert [int(spark.conf.get(k)) for k in SPLIT_BYTES] == [*SPLIT_BYTES.values()]
        assert int(spark.conf.get(parts)) == SHUFFLE_PARTS
        for k in SPLIT_BYTES:  # a session's own tighter bounds stay
            spark.conf.set(k, "1m")
        spark.conf.set(parts, "5000")
        Tables(spark, "/nowhere")
        assert [spark.conf.get(k) for k in SPLIT_BYTES] == ["1m"] * len(SPLIT_BYTES) and spark.conf.get(parts) == "5000"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
