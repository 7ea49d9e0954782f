"""Dimensions, facts and row versions of the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.aggregates import mean, ratio, total
from ..functions.dates import elapsed_days_floor, moment
from ..functions.quantiles import quantile_bins
from ..functions.skew import join_on_key
from ..functions.text import lookup
from ..schemas import CITY_SIZES, STATE_REGIONS

OPEN_END = "9999-12-31"

# How the mean of a measure is called in the daily facts.
MEAN_NAMES = {"review_score": "review_score_avg", "delivery_delay_days": "delivery_delay_avg"}


# ---- predicates ---------------------------------------------------------

def current_rows(dim: DataFrame) -> DataFrame:
    return dim.where("is_current")


def high_value_customers(df: DataFrame, threshold: float = 1000) -> DataFrame:
    return df.where(F.col("lifetime_value") > threshold)


def active_orders(orders: DataFrame) -> DataFrame:
    return orders.where(~F.col("order_status").isin("delivered", "canceled"))


# ---- dimensions ---------------------------------------------------------

def date_dimension(df: DataFrame, ts: str, holidays: DataFrame | None = None) -> DataFrame:
    """One row per distinct date.  Monday is day 0.

    ``is_holiday`` is added where a ``date_id`` frame of holidays is given.
    """
    dates = df.select(F.to_date(ts).alias("date_id")).where("date_id is not null").distinct()
    dim = dates.select(
        "date_id",
        F.year("date_id").alias("year"),
        F.month("date_id").alias("month"),
        F.dayofmonth("date_id").alias("day"),
        F.quarter("date_id").alias("quarter"),
        F.weekday("date_id").alias("day_of_week"),
        F.date_format("date_id", "EEEE").alias("day_name"),
        F.date_format("date_id", "MMMM").alias("month_name"),
        (F.weekday("date_id") >= 5).alias("is_weekend"),
    )
    if holidays is None:
        return dim
    marked = holidays.select("date_id").distinct().withColumn("is_holiday", F.lit(True))
    return dim.join(marked, "date_id", "left").fillna(False, subset=["is_holiday"])


def customer_dimension(
    customers: DataFrame,
    city_sizes: dict[str, str] = CITY_SIZES,
    state_regions: dict[str, str] = STATE_REGIONS,
) -> DataFrame:
    return customers.withColumns(
        {
            "customer_city_size": lookup("customer_city", city_sizes, "Medium"),
            "customer_region": lookup("customer_state", state_regions, "Other"),
        }
    )


def product_dimension(products: DataFrame) -> DataFrame:
    """Volume, and equal-count size and weight classes."""
    volume = F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
    return quantile_bins(
        products.withColumn("product_volume_cm3", volume),
        {
            "product_volume_cm3": ("product_size_category", ["Small", "Medium", "Large"]),
            "product_weight_g": ("product_weight_category", ["Light", "Medium", "Heavy"]),
        },
    )


def dim_customer_lifetime(customers: DataFrame, fact: DataFrame) -> DataFrame:
    """Customers with first and last order date, order count and amount."""
    lifetime = fact.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.countDistinct("order_id").alias("total_orders"),
        total("total_amount").alias("total_amount"),
    )
    return customers.join(lifetime, "customer_id", "left").fillna(
        0, subset=["total_orders", "total_amount"]
    )


def dim_seller_lifetime(sellers: DataFrame, fact: DataFrame) -> DataFrame:
    """Sellers with first and last sale date, sales, revenue and rating."""
    lifetime = fact.groupBy("seller_id").agg(
        F.min("order_date").alias("first_sale_date"),
        F.max("order_date").alias("last_sale_date"),
        F.count(F.lit(1)).alias("total_sales"),
        total("total_amount").alias("total_revenue"),
        mean("review_score").alias("seller_rating"),
    )
    return sellers.join(lifetime, "seller_id", "left").fillna(
        0, subset=["total_sales", "total_revenue"]
    )


def scd2_open(snapshot: DataFrame, as_of) -> DataFrame:
    """A first load: every row valid from ``as_of``."""
    return snapshot.withColumns(
        {"valid_from": moment(as_of), "valid_to": moment(OPEN_END), "is_current": F.lit(True)}
    )


def scd2_merge(current: DataFrame, snapshot: DataFrame, key: str, cols: list[str], as_of) -> DataFrame:
    """Close changed versions at ``as_of`` and open new ones.

    One full join on the key; rows absent from the snapshot stay open.
    Versions are keyed by ``(key, valid_from)``.
    """
    data = [key, *cols]
    shape = [*data, "valid_from", "valid_to", "is_current"]
    closed = current.where(~F.col("is_current")).select(*shape)
    old = current.where("is_current").select(F.struct(*shape).alias("old"), F.col(key).alias("_ok"))
    new = snapshot.select(F.struct(*data).alias("new"), F.col(key).alias("_nk"))
    pairs = old.join(new, F.col("_ok") == F.col("_nk"), "full")

    differs = reduce(
        lambda a, b: a | b,
        [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in cols],
    )
    known, arrived = F.col("_ok").isNotNull(), F.col("_nk").isNotNull()
    changed = known & arrived & differs

    def row(source: str, start: Column, end: Column, live: Column) -> Column:
        values = [F.col(f"{source}.{c}").alias(c) for c in data]
        return F.struct(
            *values, start.alias("valid_from"), end.alias("valid_to"), live.alias("is_current")
        )

    kept = row(
        "old",
        F.col("old.valid_from"),
        F.when(changed, moment(as_of)).otherwise(F.col("old.valid_to")),
        ~changed,
    )
    opened = row("new", moment(as_of), moment(OPEN_END), F.lit(True))
    versions = F.array(F.when(known, kept), F.when(arrived & (~known | changed), opened))
    fresh = (
        pairs.select(F.explode(versions).alias("v")).where("v is not null").select("v.*")
    )
    return closed.unionByName(fresh)


def scd2_history(observed: DataFrame, key: str, cols: list[str], at: str = "observed_at") -> DataFrame:
    """Versions from all observations ``(key, cols, at)``, in whatever order they came.

    Observations that equal the one before them open no version; of several at one moment
    the greatest counts.  An observation that comes late splits the version it falls into,
    which needs all observations of its key, not only the versions: keep them, and make
    the history of the touched keys anew (``scd2_late``).
    """
    data = F.struct(*[F.col(c) for c in cols])
    one = observed.where(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("valid_from")).agg(F.max(data).alias("data"))
    along = W.partitionBy(key).orderBy("valid_from")
    before = F.lag(F.struct("data")).over(along)
    opened = one.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before.data").eqNullSafe(F.col("data")))
    until = F.lead("valid_from").over(along)
    return opened.select(
        key, "data.*", "valid_from", F.coalesce(until, moment(OPEN_END)).alias("valid_to"), until.isNull().alias("is_current")
    )


def scd2_late(history: DataFrame, observed: DataFrame, new: DataFrame, key: str, cols: list[str], at: str = "observed_at") -> DataFrame:
    """The history after ``new`` observations; ``observed`` are all, the new ones included.

    Only keys with new observations are made again.
    """
    keys = new.select(key).distinct()
    again = scd2_history(observed.join(keys, key, "left_semi"), key, cols, at)
    return history.join(keys, key, "left_anti").unionByName(again)


def at_its_time(facts: DataFrame, history: DataFrame, key: str, ts: str, cols: list[str], slices: str = "quarter") -> DataFrame:
    """Facts with the columns of the version that was valid at their moment, null without one.

    Facts and versions are sorted together by key and time slice, and a fact takes the
    last version before it: no range join.  A version stands in every slice that it
    reaches into, so a key with very many facts is spread over its slices.
    """
    step = {"day": "interval 1 day", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[slices]
    bounds = facts.agg(F.date_trunc(slices, F.min(ts)).alias("lo"), F.date_trunc(slices, F.max(ts)).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    starts, ends = F.greatest(F.date_trunc(slices, "valid_from"), lo), F.least(F.date_trunc(slices, F.col("valid_to")), hi)
    version = F.struct(*[F.col(c).alias(c) for c in cols], "valid_to")
    versions = history.where(starts <= ends).select(
        F.col(key).alias("_key"), F.explode(F.sequence(starts, ends, F.expr(step))).alias("_slice"),
        F.col("valid_from").alias("_at"), version.alias("_version"), F.lit(None).cast(facts.schema).alias("_fact"),
    )
    rows = facts.select(
        F.col(key).alias("_key"), F.date_trunc(slices, ts).alias("_slice"), F.col(ts).alias("_at"),
        F.lit(None).cast(versions.schema["_version"].dataType).alias("_version"), F.struct("*").cast(facts.schema).alias("_fact"),
    )
    # At one moment, a version comes before the facts.
    along = W.partitionBy("_key", "_slice").orderBy("_at", F.col("_fact").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = rows.unionByName(versions).withColumn("_last", F.last("_version", ignorenulls=True).over(along)).where("_fact is not null")
    valid = F.col("_at") < F.col("_last.valid_to")
    return found.select("_fact.*", *[F.when(valid, F.col(f"_last.{c}")).alias(c) for c in cols])


# ---- facts --------------------------------------------------------------

def review_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(F.max("review_score").alias("review_score"))


def payment_per_order(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.max("payment_type").alias("payment_type"),
        F.max("payment_installments").alias("payment_installments"),
    )


def sales_fact(
    orders: DataFrame,
    items: DataFrame,
    reviews: DataFrame | None = None,
    payments: DataFrame | None = None,
    delivered: str = "order_delivered_customer_date",
) -> DataFrame:
    """Order lines with order columns, delays and amounts.

    Reviews and payments are reduced to one row per order and joined to the
    orders first, so a line is never repeated.
    """
    head = orders
    extras = []
    if reviews is not None:
        head, extras = head.join(review_per_order(reviews), "order_id", "left"), ["review_score"]
    if payments is not None:
        head = head.join(payment_per_order(payments), "order_id", "left")
        extras = [*extras, "payment_type", "payment_installments"]
    optional = [c for c in ("discount", "is_returned") if c in items.columns]
    lines = join_on_key(items, head, "order_id") if extras else items.join(head, "order_id")
    return lines.select(
        "order_id",
        "order_item_id",
        "customer_id",
        "seller_id",
        "product_id",
        F.to_date("order_purchase_timestamp").alias("order_date"),
        F.col("order_purchase_timestamp").alias("order_timestamp"),
        "order_status",
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("total_amount"),
        elapsed_days_floor(delivered, "order_estimated_delivery_date").alias("delivery_delay_days"),
        elapsed_days_floor(delivered, "order_purchase_timestamp").alias("shipping_days"),
        *optional,
        *extras,
    )


def order_summary(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    fan_out: bool = True,
) -> DataFrame:
    """One row per order with item, payment and review figures.

    The source view joins items, payments and reviews side by side, so its
    sums grow with the number of payments and reviews.  That is kept by
    default, as a weight on pre-aggregated sides instead of multiplied rows;
    ``fan_out=False`` gives the true sums.
    """
    lines = items.groupBy("order_id").agg(
        F.countDistinct("product_id").alias("total_items"),
        F.sum("price").alias("_price"),
        F.sum("freight_value").alias("_freight"),
    )
    paid = payments.groupBy("order_id").agg(
        F.max("payment_type").alias("payment_type"),
        F.max("payment_installments").alias("payment_installments"),
        F.count(F.lit(1)).alias("_paid"),
    )
    rated = reviews.groupBy("order_id").agg(
        F.max("review_score").alias("review_score"), F.count(F.lit(1)).alias("_rated")
    )
    weight = F.lit(1)
    if fan_out:
        weight = F.coalesce("_paid", F.lit(1)) * F.coalesce("_rated", F.lit(1))
    return (
        orders.join(lines, "order_id", "left")
        .join(paid, "order_id", "left")
        .join(rated, "order_id", "left")
        .select(
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            F.coalesce("total_items", F.lit(0)).alias("total_items"),
            (F.col("_price") * weight).cast("double").alias("total_amount"),
            (F.col("_freight") * weight).cast("double").alias("total_freight"),
            "payment_type",
            "payment_installments",
            "review_score",
        )
    )


def _day_metrics(
    fact: DataFrame, products: DataFrame, key: str, amount: str, favorite: str, *means: str
) -> DataFrame:
    """Figures per key and day, with the most frequent category.

    Lines are summed per order and product, then per product, category and
    day, so distinct products and category counts fall out of the same sums.
    One product of each order carries a mark that counts the order.  The
    greatest name wins a tie.
    """
    keys = [key, "order_date"]
    sums = {"items": F.count(F.lit(1)), "amount": F.sum("total_amount")}
    for m in means:
        sums[f"{m}_sum"], sums[f"{m}_n"] = F.sum(m), F.count(m)

    def named(exprs: dict[str, Column]) -> list[Column]:
        return [c.alias(n) for n, c in exprs.items()]

    again = {n: F.sum(n) for n in sums} | {"orders_count": F.sum("orders_count")}
    in_order = W.partitionBy(*keys, "order_id").orderBy("product_id")
    by_category = (
        fact.repartition(*keys, "order_id")
        .groupBy(*keys, "order_id", "product_id")
        .agg(*named(sums))
        .withColumn("orders_count", (F.row_number().over(in_order) == 1).cast("long"))
        .groupBy(*keys, "product_id")
        .agg(*named(again))
        .join(products.select("product_id", "product_category_name"), "product_id", "left")
        .groupBy(*keys, "product_category_name")
        .agg(F.count(F.lit(1)).alias("products"), *named(again))
    )
    category = F.col("product_category_name")
    best = F.max_by(category, F.when(category.isNotNull(), F.struct("items", category)))
    per_day = by_category.groupBy(*keys).agg(
        best.alias(favorite), F.sum("products").alias("unique_products"), *named(again)
    )
    return per_day.select(
        key,
        F.col("order_date").alias("date_id"),
        "orders_count",
        F.col("amount").cast("double").alias(amount),
        ratio(F.col("amount"), F.col("orders_count")).alias("average_order_value"),
        F.col("items").alias("total_items"),
        "unique_products",
        favorite,
        *[ratio(F.col(f"{m}_sum"), F.col(f"{m}_n")).alias(MEAN_NAMES[m]) for m in means],
    )


def fact_customer_metrics(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Customer by day."""
    return _day_metrics(
        fact, products, "customer_id", "total_amount", "favorite_category", "review_score"
    )


def fact_seller_metrics(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Seller by day."""
    return _day_metrics(
        fact, products, "seller_id", "total_revenue", "top_category", "review_score", "delivery_delay_days"
    )


def fact_product_metrics(fact: DataFrame) -> DataFrame:
    """Product by day."""
    return (
        fact.groupBy("product_id", "order_date")
        .agg(
            F.countDistinct("order_id").alias("orders_count"),
            total("total_amount").alias("total_revenue"),
            mean("price").alias("average_price"),
            F.count(F.lit(1)).alias("total_quantity"),
            mean("review_score").alias("review_score_avg"),
        )
        .withColumnRenamed("order_date", "date_id")
    )


def fact_customer_satisfaction(reviews: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp("review_answer_timestamp") - F.unix_timestamp("review_creation_date")
    return reviews.select(
        "review_id",
        "order_id",
        "customer_id",
        F.to_date("review_creation_date").alias("review_date"),
        "review_score",
        F.col("review_comment_message").isNotNull().cast("int").alias("has_review_comment"),
        (seconds / F.lit(3600)).alias("review_response_time_hours"),
    )


def denormalize_order(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    customers: DataFrame,
    page_lines: int = 100,
) -> DataFrame:
    """Nested documents of orders: page ``p`` holds the lines ``p * page_lines + 1`` and on.

    A line's page follows from its own number at every size of an order, and
    a page is bounded.  An order without lines has page 0 with null items.
    """
    item_cols = [c for c in items.columns if c != "order_id"]
    page = F.floor((F.col("order_item_id") - 1) / page_lines).cast("int").alias("page")
    lists = items.groupBy("order_id", page).agg(F.sort_array(F.collect_list(F.struct(*item_cols))).alias("items"))

    def nested(df: DataFrame, name: str, order_by: str) -> DataFrame:
        fields = [c for c in df.columns if c != "order_id"]
        pick = F.max_by(F.struct(*fields), F.col(order_by))
        return df.groupBy("order_id").agg(pick.alias(name))

    head = (
        orders.alias("o")
        .join(customers.alias("c"), "customer_id", "left")
        .select(
            F.col("o.order_id").alias("order_id"),
            F.struct(*[F.col(f"o.{c}").alias(c) for c in orders.columns]).alias("order"),
            F.struct(
                *[
                    F.col("customer_id") if c == "customer_id" else F.col(f"c.{c}").alias(c)
                    for c in customers.columns
                ]
            ).alias("customer"),
        )
    )
    return (
        head.join(nested(payments, "payment", "payment_sequential"), "order_id", "left")
        .join(nested(reviews, "review", "review_id"), "order_id", "left")
        .join(lists, "order_id", "left")
        .select(
            "order_id",
            F.coalesce("page", F.lit(0)).alias("page"),
            "order",
            "items",
            "payment",
            "review",
            "customer",
        )
    )
