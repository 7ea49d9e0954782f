"""Co-purchase analysis: recommendations, category baskets, association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.aggregates import mean
from ..functions.checks import require
from ..functions.skew import join_on_key
from ..session import stored
from .warehouse import current_rows

# Rows of one customer and time slice that one task may order.
SLICE_ROWS = 1_000_000


def product_recommendations(
    fact: DataFrame, products: DataFrame, product_id, days: int = 30, limit: int = 10
) -> DataFrame:
    """Products bought by the same customer in a later order within ``days``.

    The count is the number of (earlier line, later line) pairs, but no pair
    is built: each earlier purchase opens a window that closes ``days`` later,
    and a running sum in time order tells how many are open at each later
    line.  Time is cut into slices of ``days``, so a window touches two
    slices; a slice with very many rows is split further by product.
    """
    require(fact, "customer_id", "product_id", "order_timestamp", "price", "review_score")
    span = days * 86_400_000_000
    live = current_rows(products).select("product_id", "product_category_name")
    sales = fact.select(
        "customer_id", "product_id", F.unix_micros("order_timestamp").alias("at")
    )
    opened = (
        sales.where(F.col("product_id") == F.lit(product_id))
        .join(live.where(F.col("product_id") == F.lit(product_id)), "product_id", "left_semi")
        .groupBy("customer_id", "at")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("slice", F.floor(F.col("at") / span))
    )
    later = (
        sales.join(opened.select("customer_id"), "customer_id", "left_semi")
        .join(live.select("product_id"), "product_id", "left_semi")
        .withColumn("slice", F.floor(F.col("at") / span))
        .groupBy("customer_id", "slice", "at", "product_id")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    # A split slice holds over SLICE_ROWS rows, so there are few of them.
    splits = F.broadcast(
        later.groupBy("customer_id", "slice")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).cast("int").alias("splits"))
        .where("splits > 1")
    )
    pieces = F.coalesce("splits", F.lit(1))
    next_slice = F.col("slice") + 1
    moves = F.array(
        F.struct(F.col("slice").alias("slice"), F.col("at").alias("at"), F.col("n").alias("step")),
        F.struct(next_slice.alias("slice"), (next_slice * span - 1).alias("at"), F.col("n").alias("step")),
        F.struct(next_slice.alias("slice"), (F.col("at") + span).alias("at"), (-F.col("n")).alias("step")),
    )
    steps = (
        opened.select("customer_id", F.explode(moves).alias("m"))
        .select("customer_id", "m.*")
        .join(splits, ["customer_id", "slice"], "left")
        .withColumn("split", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .select("customer_id", "slice", "split", "at", "step", F.lit(None).alias("product_id"), F.lit(0).alias("lines"))
    )
    demand = later.join(splits, ["customer_id", "slice"], "left").select(
        "customer_id",
        "slice",
        F.pmod(F.xxhash64("product_id"), pieces).cast("int").alias("split"),
        "at",
        F.lit(0).alias("step"),
        "product_id",
        "lines",
    )
    before = (
        W.partitionBy("customer_id", "slice", "split")
        .orderBy("at")
        .rangeBetween(W.unboundedPreceding, -1)
    )
    counts = (
        demand.unionByName(steps)
        .withColumn("open", F.coalesce(F.sum("step").over(before), F.lit(0)))
        .where("product_id is not null and open > 0")
        .groupBy("product_id")
        .agg(F.sum(F.col("lines") * F.col("open")).alias("co_purchase_count"))
    )
    # Only products that can be among the first get their averages.
    best = counts.join(live.select("product_id"), "product_id", "left_semi")
    best = best.withColumn("place", F.rank().over(W.orderBy(F.desc("co_purchase_count")))).where(F.col("place") <= limit)
    counts = best.drop("place")
    value = fact.join(counts.select("product_id"), "product_id", "left_semi").groupBy("product_id").agg(
        mean("price").alias("avg_price"), mean("review_score").alias("avg_rating")
    )
    return (
        counts.join(live, "product_id")
        .join(value, "product_id")
        .select(
            F.col("product_id").alias("recommended_product_id"),
            "product_category_name",
            "co_purchase_count",
            "avg_price",
            "avg_rating",
        )
        .orderBy(
            F.desc("co_purchase_count"), F.desc_nulls_last("avg_rating"), "recommended_product_id"
        )
        .limit(limit)
    )


def recommend_for_customer(fact: DataFrame, customer_id, n: int = 10) -> DataFrame:
    """Products not yet bought, by number of orders shared with bought ones."""
    require(fact, "customer_id", "order_id", "product_id")
    lines = fact.select("order_id", "product_id")
    owned = fact.where(F.col("customer_id") == F.lit(customer_id)).select("product_id")
    orders = lines.join(owned, "product_id", "left_semi").select("order_id").distinct()
    return (
        join_on_key(lines, orders, "order_id", "left_semi")
        .join(owned, "product_id", "left_anti")
        .groupBy("product_id")
        .agg(F.countDistinct("order_id").alias("score"))
        .orderBy(F.desc("score"), "product_id")
        .limit(n)
    )


def market_basket(
    fact: DataFrame,
    products: DataFrame,
    min_support: float = 0.01,
    min_confidence: float = 0.1,
    oriented: bool = True,
) -> DataFrame:
    """Category pairs with support and both confidences.

    As in the source query a pair is oriented by product id, so (A, B), (B, A)
    and (A, A) are separate rows; ``oriented=False`` merges them.

    An order is first reduced to its categories with their smallest and
    largest product: categories a and b form a pair exactly when the smallest
    product of a lies below the largest of b.  Categories too rare for any
    pair to reach the support are left out beforehand, which changes nothing
    in the result and bounds the pairs of even the largest order.
    """
    require(fact, "order_id", "product_id")
    if min_support <= 0:
        raise ValueError("min_support must be above 0: it bounds the pairs of an order")
    cat = "product_category_name"
    live = current_rows(products).select("product_id", cat)
    total_orders = fact.agg(F.countDistinct("order_id")).scalar()
    in_order = (
        fact.select("order_id", "product_id")
        .distinct()
        .join(live, "product_id")
        .groupBy("order_id", cat)
        .agg(F.min("product_id").alias("lo"), F.max("product_id").alias("hi"))
    )
    frequent = (
        in_order.groupBy(cat)
        .agg(F.count(F.lit(1)).alias("orders"))
        .where(F.col("orders") / total_orders >= min_support)
    )
    kept = in_order.join(frequent, cat)
    # Each pair of categories meets once; both directions are read off it.  Both
    # sides then carry the same columns, so Spark shuffles them only once.
    a, b = kept.alias("a"), kept.alias("b")
    up = F.col("a.lo") < F.col("b.hi")
    down = (F.col("b.lo") < F.col("a.hi")) & (F.col(f"a.{cat}") != F.col(f"b.{cat}"))
    met = a.join(b, (F.col("a.order_id") == F.col("b.order_id")) & (F.col(f"a.{cat}") <= F.col(f"b.{cat}")))
    counts = met.groupBy(
        F.col(f"a.{cat}").alias("x"),
        F.col(f"b.{cat}").alias("y"),
        F.col("a.orders").alias("nx"),
        F.col("b.orders").alias("ny"),
    ).agg(
        F.count_if(up).alias("up"),
        F.count_if(down).alias("down"),
        F.count_if(F.col(f"a.{cat}") != F.col(f"b.{cat}")).alias("both"),
    )

    def pair(first: str, second: str, count: str) -> Column:
        return F.struct(
            F.col(first).alias("category1"),
            F.col(second).alias("category2"),
            F.col(f"n{first}").alias("n1"),
            F.col(f"n{second}").alias("n2"),
            F.col(count).alias("pair_count"),
        )

    wanted = [pair("x", "y", "up"), pair("y", "x", "down")] if oriented else [pair("x", "y", "both")]
    pairs = counts.select(F.explode(F.array(*wanted)).alias("p")).select("p.*").where("pair_count > 0")
    return (
        pairs.select(
            "category1",
            "category2",
            (F.col("pair_count") / total_orders).alias("support"),
            (F.col("pair_count") / F.col("n1")).alias("confidence_1_2"),
            (F.col("pair_count") / F.col("n2")).alias("confidence_2_1"),
            "pair_count",
        )
        .where(F.col("support") >= min_support)
        .where((F.col("confidence_1_2") >= min_confidence) | (F.col("confidence_2_1") >= min_confidence))
        .orderBy(F.desc("support"), "category1", "category2")
    )


def frequent_baskets(lines: DataFrame, item: str, min_support: float) -> tuple[DataFrame, int]:
    """``order_id, items`` with only the items that reach the support, and the
    number of orders.

    The pruning is exact, as a frequent set has frequent items only, and it
    bounds the list of the largest order.  Orders left empty are dropped from
    the lists but stay in the returned number.
    """
    pairs = lines.select("order_id", item).where(F.col(item).isNotNull()).distinct()
    orders = lines.select("order_id").distinct().count()
    frequent = (
        pairs.groupBy(item)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_support * orders)
        .select(item)
    )
    baskets = (
        pairs.join(frequent, item, "left_semi")
        .groupBy("order_id")
        .agg(F.collect_list(item).alias("items"))
    )
    return baskets, orders


def stored_baskets(lines: DataFrame, item: str, min_support: float) -> tuple[DataFrame, int]:
    """Baskets kept in the shared folder: mining reads them several times."""
    baskets, orders = frequent_baskets(lines, item, min_support)
    return stored(baskets, "baskets"), orders


def association_rules(
    lines: DataFrame, item: str, min_support: float = 0.01, min_confidence: float = 0.5
) -> DataFrame:
    """Rules with support, confidence and lift by parallel FP-growth.

    Supports are relative to all orders, also those without a frequent item.
    """
    baskets, orders = stored_baskets(lines, item, min_support)
    listed = baskets.count()
    if not listed:
        raise ValueError("no item reaches the minimum support")
    # FP-growth sees the non-empty baskets only: scale the threshold and the
    # measures back to all orders.
    scale = listed / orders
    growth = FPGrowth(
        itemsCol="items",
        minSupport=min(min_support / scale, 1.0) * (1 - 1e-12),
        minConfidence=min_confidence,
    )
    rules = growth.fit(baskets).associationRules
    return rules.select(
        F.sort_array("antecedent").alias("antecedent"),
        "consequent",
        (F.col("support") * scale).alias("support"),
        "confidence",
        (F.col("lift") / scale).alias("lift"),
    )
