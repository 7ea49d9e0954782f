"""Category, product and seller performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.aggregates import mean, ratio, total
from ..functions.dates import between_dates, days_before, moment, optional_date_filter
from ..functions.skew import join_on_key


def _rated_orders(orders: DataFrame, reviews: DataFrame, start, end, fan_out: bool) -> DataFrame:
    """Orders in range with the weight their reviews give to each line.

    Joining reviews to lines repeats a line once per review.  The weight has
    the same effect on sums and averages without repeating rows;
    ``fan_out=False`` counts every line once and takes the order's mean score.
    """
    per = reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("review_score").alias("score"),
        F.count("review_score").alias("scored"),
    )
    sold = optional_date_filter(orders, "order_purchase_timestamp", start, end)
    joined = sold.select("order_id").join(per, "order_id", "left")
    if fan_out:
        return joined.select("order_id", F.coalesce("n", F.lit(1)).alias("weight"), "score", "scored")
    return joined.select(
        "order_id",
        F.lit(1).alias("weight"),
        ratio(F.col("score"), F.col("scored")).alias("score"),
        F.when(F.col("scored") > 0, 1).alias("scored"),
    )


def _weighted_lines(items: DataFrame, heads: DataFrame, *keys: str) -> DataFrame:
    """Lines with the weight of their order."""
    price = (F.col("price") * F.col("weight")).alias("price")
    lines = items.select("order_id", *keys, "price")
    return join_on_key(lines, heads, "order_id").select("order_id", *keys, price, "score", "scored")


def product_performance(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    reviews: DataFrame,
    start=None,
    end=None,
    fan_out: bool = True,
) -> DataFrame:
    """Per category: orders, revenue and average rating."""
    heads = _rated_orders(orders, reviews, start, end, fan_out)
    lines = _weighted_lines(items, heads, "product_id")
    return (
        lines.join(products.select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            total("price").alias("total_revenue"),
            ratio(F.sum("score"), F.sum("scored")).alias("avg_rating"),
        )
        .orderBy(F.desc("total_revenue"))
    )


def seller_analytics(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    reviews: DataFrame,
    start=None,
    end=None,
    fan_out: bool = True,
) -> DataFrame:
    """Per seller: orders, revenue, average rating, categories."""
    heads = _rated_orders(orders, reviews, start, end, fan_out)
    lines = _weighted_lines(items, heads, "seller_id", "product_id")
    # Sums per order and category, then per category: no row is expanded for a distinct count.
    in_order = W.partitionBy("seller_id", "order_id").orderBy("product_category_name")
    sums = [F.sum(c).alias(c) for c in ("price", "score", "scored")]
    per_category = (
        lines.join(products.select("product_id", "product_category_name"), "product_id")
        .repartition("seller_id", "order_id")
        .groupBy("seller_id", "order_id", "product_category_name")
        .agg(*sums)
        .withColumn("orders", (F.row_number().over(in_order) == 1).cast("long"))
        .groupBy("seller_id", "product_category_name")
        .agg(*sums, F.sum("orders").alias("orders"))
    )
    return (
        per_category.groupBy("seller_id")
        .agg(
            F.sum("orders").alias("total_orders"),
            total("price").alias("total_revenue"),
            ratio(F.sum("score"), F.sum("scored")).alias("avg_rating"),
            F.count("product_category_name").alias("unique_categories"),
        )
        .join(sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
        .orderBy(F.desc("total_revenue"), "seller_id")
    )


def category_performance(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Per English category name.  Sales meet their product already summed."""
    per = fact.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("total_amount").alias("amount"),
        F.sum("price").alias("price"),
        F.sum("shipping_days").alias("days"),
        F.count("shipping_days").alias("shipped"),
    )
    name = "product_category_name_english"
    return (
        per.join(products.select("product_id", name), "product_id")
        .groupBy(name)
        .agg(
            F.sum("lines").alias("total_sales"),
            total("amount").alias("total_revenue"),
            ratio(F.sum("price"), F.sum("lines")).alias("average_price"),
            ratio(F.sum("days"), F.sum("shipped")).alias("average_shipping_days"),
        )
        .orderBy(F.desc("total_revenue"))
    )


def top_categories(performance: DataFrame, n: int = 10) -> DataFrame:
    name = "product_category_name_english"
    return performance.select(name, "total_revenue").orderBy(F.desc("total_revenue"), name).limit(n)


def q_product_performance(fact: DataFrame, products: DataFrame, start, end) -> DataFrame:
    """Per category: orders, revenue, average line, customers."""
    rows = between_dates(fact, "order_timestamp", start, end)
    lines = rows.groupBy("product_id", "order_id", "customer_id").agg(
        F.sum("total_amount").alias("amount"), F.count(F.lit(1)).alias("lines")
    )
    name = "product_category_name"
    return (
        lines.join(products.select("product_id", name), "product_id")
        .groupBy(name, "order_id", "customer_id")
        .agg(F.sum("amount").alias("amount"), F.sum("lines").alias("lines"))
        .groupBy(name)
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            total("amount").alias("total_revenue"),
            ratio(F.sum("amount"), F.sum("lines")).alias("avg_order_value"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
        .orderBy(F.desc("total_revenue"))
    )


def q_seller_performance(fact: DataFrame, sellers: DataFrame, start, end) -> DataFrame:
    per = between_dates(fact, "order_timestamp", start, end).groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        total("total_amount").alias("total_revenue"),
        mean("delivery_delay_days").alias("avg_delivery_delay"),
        mean("review_score").alias("avg_review_score"),
    )
    return per.join(sellers.select("seller_id", "seller_city"), "seller_id").orderBy(
        F.desc("total_revenue"), "seller_id"
    )


def seller_performance(fact: DataFrame, sellers: DataFrame) -> DataFrame:
    """Per seller: lines, revenue, average delay."""
    per = fact.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        total("total_amount").alias("total_revenue"),
        mean("delivery_delay_days").alias("average_delivery_delay"),
    )
    return per.join(sellers, "seller_id").orderBy(F.desc("total_revenue"), "seller_id")


def product_performance_v2(
    fact: DataFrame, products: DataFrame, category: str | None = None, start=None, end=None, limit: int = 100
) -> DataFrame:
    """Top products by revenue with units, rating and return rate."""
    dim = products.select("product_id", F.col("product_category_name").alias("category"))
    if category is not None:
        dim = dim.where(F.col("category") == category)
    per = optional_date_filter(fact, "order_date", start, end).groupBy("product_id").agg(
        total("total_amount").alias("revenue"),
        F.count(F.lit(1)).alias("units_sold"),
        mean("review_score").alias("average_rating"),
        ratio(F.count_if("is_returned"), F.count(F.lit(1))).alias("return_rate"),
    )
    return per.join(dim, "product_id").orderBy(F.desc("revenue"), "product_id").limit(limit)


def mv_product_performance(products: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Every product with order, price, freight and customer figures."""
    per_order = items.groupBy("product_id", "order_id").agg(
        F.sum("price").alias("price"),
        F.count("price").alias("lines"),
        F.sum("freight_value").alias("freight"),
    )
    value = (
        per_order.join(orders.select("order_id", "customer_id"), "order_id", "left")
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            total("price").alias("total_revenue"),
            ratio(F.sum("price"), F.sum("lines")).alias("avg_price"),
            total("freight").alias("total_freight"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )
    return (
        products.select("product_id", "product_category_name")
        .join(value, "product_id", "left")
        .fillna(0, subset=["total_orders", "unique_customers"])
    )


DEFAULT_WEIGHTS = {"revenue": 0.4, "margin": 0.3, "growth": 0.2, "return_rate": -0.1}


def product_score(
    fact: DataFrame, as_of, weights: dict[str, float] | None = None, period_days: int = 365
) -> DataFrame:
    """Weighted sum of min-max scaled measures per product.

    Definitions chosen here: margin is the share of the price left after the
    discount; growth compares the last period with the one before it.
    """
    weights = weights or DEFAULT_WEIGHTS
    ts, price = F.col("order_timestamp"), F.col("price")
    recent = ts >= days_before(as_of, period_days)
    earlier = ~recent & (ts >= days_before(as_of, 2 * period_days))
    now = F.sum(F.when(recent, price)).cast("double")
    then = F.sum(F.when(earlier, price)).cast("double")
    per = fact.where(ts < moment(as_of)).groupBy("product_id").agg(
        total("total_amount").alias("revenue"),
        ratio(F.sum(price * (1 - F.col("discount"))), F.sum(price)).alias("margin"),
        F.coalesce(ratio(now - then, then), F.lit(0.0)).alias("growth"),
        ratio(F.count_if("is_returned"), F.count(F.lit(1))).alias("return_rate"),
    )
    measures = list(weights)
    span = per.agg(
        F.struct(*[F.struct(F.min(m).alias("lo"), F.max(m).alias("hi")).alias(m) for m in measures])
    ).scalar()

    def scaled(m: str) -> Column:
        lo, hi = F.col(f"_span.{m}.lo"), F.col(f"_span.{m}.hi")
        return F.coalesce(ratio(F.col(m) - lo, hi - lo), F.lit(0.0))

    score = sum((scaled(m) * w for m, w in weights.items()), F.lit(0.0))
    return per.withColumn("_span", span).withColumn("score", score).drop("_span")
