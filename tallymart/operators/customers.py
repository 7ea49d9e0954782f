"""Lifetime value, segments, RFM scores and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.aggregates import mean, ratio, total
from ..functions.checks import require
from ..functions.dates import days_before, elapsed_days_floor, elapsed_days_trunc, lookback, moment
from ..functions.quantiles import quantile_bins
from ..session import stored
from .sales import order_totals
from .warehouse import current_rows


def average_order(per_order: bool) -> Column:
    """The average line, as in the source queries, or the average order."""
    if per_order:
        return ratio(F.sum("total_amount"), F.countDistinct("order_id"))
    return mean("total_amount")


def customer_ltv(
    fact: DataFrame, dim_customer: DataFrame, as_of, lookback_days: int = 365, per_order: bool = False
) -> DataFrame:
    """Spend, orders, yearly value and days since the last purchase.

    ``annual_value`` is null for a customer seen on a single day.
    ``avg_order_value`` is the average line as in the source query;
    ``per_order=True`` gives the average order.
    """
    require(fact, "customer_id", "order_id", "order_timestamp", "total_amount")
    bought = (
        lookback(fact, "order_timestamp", lookback_days, as_of)
        .groupBy("customer_id")
        .agg(
            F.sum("total_amount").alias("spent"),
            F.countDistinct("order_id").alias("total_orders"),
            average_order(per_order).alias("avg_order_value"),
            F.max("order_timestamp").alias("last_purchase"),
            F.min("order_timestamp").alias("first_purchase"),
        )
    )
    dim = current_rows(dim_customer).select("customer_id", "customer_segment")
    spent = F.col("spent").cast("double")
    days = F.nullif(elapsed_days_trunc("last_purchase", "first_purchase"), F.lit(0))
    return (
        bought.join(dim, "customer_id")
        .select(
            "customer_id",
            spent.alias("total_spent"),
            "total_orders",
            "avg_order_value",
            (spent / days * 365).alias("annual_value"),
            "customer_segment",
            elapsed_days_trunc(moment(as_of), F.col("last_purchase")).alias("days_since_last_purchase"),
        )
        .orderBy(F.desc("total_spent"), "customer_id")
    )


def customer_ltv_v2(
    fact: DataFrame,
    dim_customer: DataFrame,
    segment: str | None = None,
    min_orders: int | None = None,
    limit: int = 100,
) -> DataFrame:
    """Top customers by spend, optionally of one segment or order count."""
    dim = dim_customer.select("customer_id", "customer_segment")
    if segment is not None:
        dim = dim.where(F.col("customer_segment") == segment)
    value = fact.groupBy("customer_id").agg(
        total("total_amount").alias("ltv"),
        F.countDistinct("order_id").alias("total_orders"),
        ratio(F.sum("total_amount"), F.countDistinct("order_id")).alias("average_order_value"),
        F.min("order_timestamp").alias("first_order_date"),
        F.max("order_timestamp").alias("last_order_date"),
    )
    if min_orders is not None:
        value = value.where(F.col("total_orders") >= min_orders)
    return (
        value.join(dim, "customer_id")
        .drop("customer_segment")
        .orderBy(F.desc("ltv"), "customer_id")
        .limit(limit)
    )


def customer_metrics(fact: DataFrame, as_of, lookback_days: int = 365, per_order: bool = False) -> DataFrame:
    require(fact, "customer_id", "order_id", "order_timestamp", "total_amount")
    return (
        lookback(fact, "order_timestamp", lookback_days, as_of)
        .groupBy("customer_id")
        .agg(
            F.countDistinct("order_id").alias("frequency"),
            average_order(per_order).alias("avg_order_value"),
            F.sum("total_amount").alias("total_spent"),
            F.max("order_timestamp").alias("last_purchase"),
            F.min("order_timestamp").alias("first_purchase"),
        )
    )


def segment_rule(as_of) -> Column:
    f, spent = F.col("frequency"), F.col("total_spent")
    return (
        F.when((f > 10) & (spent > 1000), "VIP")
        .when((f > 5) & (spent > 500), "Loyal")
        .when((f > 2) & (spent > 200), "Regular")
        .when(F.col("last_purchase") >= days_before(as_of, 90), "New")
        .otherwise("At Risk")
    )


def segmented_customers(fact: DataFrame, as_of, lookback_days: int = 365) -> DataFrame:
    return customer_metrics(fact, as_of, lookback_days).withColumn("segment", segment_rule(as_of))


def customer_segmentation(fact: DataFrame, as_of, lookback_days: int = 365) -> DataFrame:
    """Averages per rule-based segment."""
    age = elapsed_days_trunc("last_purchase", "first_purchase")
    return (
        segmented_customers(fact, as_of, lookback_days)
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            mean("frequency").alias("avg_frequency"),
            F.avg("avg_order_value").alias("avg_order_value"),
            mean("total_spent").alias("avg_total_spent"),
            mean(age).alias("avg_customer_age_days"),
        )
        .orderBy(F.desc("avg_total_spent"))
    )


def customer_segments_geo(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Region and city size.  Sales meet their customer already summed."""
    sums = fact.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("total_amount").alias("amount")
    )
    dim = dim_customer.select("customer_id", "customer_region", "customer_city_size")
    return (
        sums.join(dim, "customer_id")
        .groupBy("customer_region", "customer_city_size")
        .agg(
            F.count(F.lit(1)).alias("total_customers"),
            F.sum("lines").alias("total_orders"),
            total("amount").alias("total_revenue"),
            ratio(F.sum("amount"), F.sum("lines")).alias("average_order_value"),
        )
        .orderBy(F.desc("total_revenue"))
    )


def segment_treemap(segments: DataFrame) -> DataFrame:
    """Revenue of each region and city size, of each region, and of all."""
    return (
        segments.rollup("customer_region", "customer_city_size")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("total_revenue").alias("total_revenue"),
        )
    )


def rfm_scores(fact: DataFrame, analysis_date) -> DataFrame:
    """Recency, frequency and monetary quintiles (5 is best).

    One aggregate instead of three scans; it is stored, a row per customer,
    as the quintile edges take several passes over it.  With repeated edges
    the lowest bin wins.
    """
    require(fact, "customer_id", "order_date", "total_amount")
    rfm = fact.groupBy("customer_id").agg(
        F.max("order_date").alias("last_purchase_date"),
        F.count(F.lit(1)).alias("frequency"),
        total("total_amount").alias("monetary"),
    )
    last = F.col("last_purchase_date").cast("timestamp")
    rfm = stored(rfm.withColumn("recency", elapsed_days_floor(moment(analysis_date), last)), "rfm")
    scored = quantile_bins(
        rfm,
        {
            "recency": ("R_score", [5, 4, 3, 2, 1]),
            "frequency": ("F_score", [1, 2, 3, 4, 5]),
            "monetary": ("M_score", [1, 2, 3, 4, 5]),
        },
    )
    digits = [F.col(c).cast("string") for c in ("R_score", "F_score", "M_score")]
    return scored.withColumn("RFM_score", F.concat(*digits))


def rfm_segments(rfm: DataFrame) -> DataFrame:
    """Named segments.  The thresholds are this library's choice.

    Champions score at least 4 everywhere, Loyal at least 3 in frequency and
    recency; a low recency is At Risk where the customer used to buy often,
    else Lost.
    """
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    label = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal Customers")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("At Risk")
    )
    return rfm.withColumn("segment", label)


def rfm_histogram(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("RFM_score").agg(F.count(F.lit(1)).alias("customers")).orderBy("RFM_score")


# ---- cohorts ------------------------------------------------------------

def _first_period(active: DataFrame) -> DataFrame:
    """Add each customer's first period.

    ``active`` holds one row per customer and period, so the window sees at
    most as many rows per customer as there are periods.
    """
    own = W.partitionBy("customer_id")
    return active.withColumn("cohort_date", F.min("order_period").over(own))


def customer_cohort(orders: DataFrame, period: str = "month") -> DataFrame:
    """Active customers by first period and period.

    The source query takes the minimum inside each period, which makes both
    columns equal; this is the intended first-purchase cohort.
    """
    active = orders.select(
        "customer_id", F.to_date(F.date_trunc(period, "order_purchase_timestamp")).alias("order_period")
    ).distinct()
    return (
        _first_period(active)
        .groupBy("cohort_date", "order_period")
        .agg(F.count(F.lit(1)).alias("active_customers"))
        .orderBy("cohort_date", "order_period")
    )


def q_customer_cohort(fact: DataFrame) -> DataFrame:
    """Customers and revenue by month of first purchase: one aggregate, no join."""
    return (
        fact.groupBy("customer_id")
        .agg(
            F.to_date(F.date_trunc("month", F.min("order_timestamp"))).alias("cohort_month"),
            F.sum("total_amount").alias("amount"),
        )
        .groupBy("cohort_month")
        .agg(
            F.count(F.lit(1)).alias("total_customers"),
            total("amount").alias("total_revenue"),
        )
        .orderBy("cohort_month")
    )


def cohort_retention(fact: DataFrame, period: str | int = "month") -> DataFrame:
    """Retention in percent and average value by cohort and period offset.

    ``period`` is day, week, month, or a number of days per cohort.
    """
    day = F.col("order_date")
    if isinstance(period, int):
        epoch = F.lit("1970-01-01").cast("date")
        start = F.date_add(epoch, (F.floor(F.datediff(day, epoch) / period) * period).cast("int"))
        offset = (F.datediff("order_period", "cohort_date") / period).cast("int")
    else:
        start = F.to_date(F.date_trunc(period, day))
        offset = {
            "day": F.datediff("order_period", "cohort_date"),
            "week": (F.datediff("order_period", "cohort_date") / 7).cast("int"),
            "month": F.round(F.months_between("order_period", "cohort_date")).cast("int"),
        }[period]
    active = fact.groupBy("customer_id", start.alias("order_period")).agg(
        F.sum("total_amount").alias("amount")
    )
    by_offset = (
        _first_period(active)
        .withColumn("period_offset", offset)
        .groupBy("cohort_date", "period_offset")
        .agg(
            F.count(F.lit(1)).alias("active_customers"),
            ratio(F.sum("amount"), F.count(F.lit(1))).alias("average_value"),
        )
    )
    # Every customer is active in the first period, so offset 0 is the cohort.
    size = F.max(F.when(F.col("period_offset") == 0, F.col("active_customers"))).over(
        W.partitionBy("cohort_date")
    )
    sized = by_offset.withColumn("cohort_size", size)
    rate = F.col("active_customers") / F.col("cohort_size") * 100
    return sized.withColumn("retention_rate", rate).orderBy("cohort_date", "period_offset")


def retention_matrix(retention: DataFrame, offsets: list[int]) -> DataFrame:
    """One row per cohort, one column per requested offset."""
    return (
        retention.groupBy("cohort_date", "cohort_size")
        .pivot("period_offset", offsets)
        .agg(F.first("retention_rate"))
    )


# ---- spend and value ----------------------------------------------------

def customer_spend(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    spend = (
        orders.select("order_id", "customer_id")
        .join(order_totals(items), "order_id")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("total_orders"), total("price").alias("total_spent"))
    )
    return spend.join(customers.select("customer_id"), "customer_id", "left_semi")


def repeat_customers(orders: DataFrame, items: DataFrame, status: str = "completed") -> DataFrame:
    """Customers with more than one order of the given status."""
    return (
        orders.where(F.col("order_status") == status)
        .select("order_id", "customer_id")
        .join(order_totals(items), "order_id")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("total_orders"), total("price").alias("total_spent"))
        .where("total_orders > 1")
        .orderBy(F.desc("total_spent"), "customer_id")
    )


def mv_customer_analytics(
    customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """Every customer with order, spend and category figures.

    Lines are reduced per order, then per customer, before customers are
    joined, so no row is repeated and orders need no distinct count.
    """
    cat = products.select("product_id", "product_category_name")
    by_product = items.groupBy("order_id", "product_id").agg(
        F.sum("price").alias("price"), F.count("price").alias("lines")
    )
    per_order = by_product.join(cat, "product_id", "left").groupBy("order_id", "product_category_name").agg(
        F.sum("price").alias("price"), F.sum("lines").alias("lines")
    )
    value = (
        orders.select("order_id", "customer_id", "order_purchase_timestamp")
        .join(per_order, "order_id", "left")
        .groupBy("customer_id")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            total("price").alias("total_spent"),
            ratio(F.sum("price"), F.sum("lines")).alias("avg_order_value"),
            F.min("order_purchase_timestamp").alias("first_purchase"),
            F.max("order_purchase_timestamp").alias("last_purchase"),
            F.countDistinct("product_category_name").alias("unique_categories_bought"),
        )
    )
    return (
        customers.select("customer_id", "customer_state")
        .join(value, "customer_id", "left")
        .fillna(0, subset=["total_orders", "unique_categories_bought"])
    )


def clv_formula(fact: DataFrame, customers: DataFrame, as_of, discount_rate: float = 0.1) -> DataFrame:
    """AOV x frequency x lifespan / (1 + discount rate - retention rate).

    Definitions chosen here: lifespan is first to last purchase in years (one
    day at least), frequency is orders per year from the first purchase to
    ``as_of``, retention is the share of buyers with more than one order.
    Customers without orders have a value of 0.
    """
    per = fact.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("orders"),
        F.sum("total_amount").alias("spent"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
    )
    retention = per.agg(ratio(F.count_if(F.col("orders") > 1), F.count(F.lit(1)))).scalar()
    aov = ratio(F.col("spent"), F.col("orders"))
    lifespan = (F.datediff("last", "first") + 1) / F.lit(365.0)
    observed = F.greatest(F.datediff(moment(as_of), F.col("first")) + 1, F.lit(1)) / F.lit(365.0)
    ltv = aov * (F.col("orders") / observed) * lifespan / (1 + discount_rate - F.col("_r"))
    valued = per.withColumn("_r", retention).select("customer_id", ltv.alias("ltv"))
    return (
        customers.select("customer_id").join(valued, "customer_id", "left").fillna(0.0, subset=["ltv"])
    )


def churn_features(fact: DataFrame, as_of, horizon_days: int = 90) -> DataFrame:
    """Features up to the cut-off and whether an order followed within the horizon.

    Features and label come from one pass over the sales.
    """
    cut = days_before(as_of, horizon_days)
    ts = F.col("order_timestamp")
    before, after = ts < cut, (ts >= cut) & (ts < moment(as_of))
    per_order = fact.groupBy("customer_id", "order_id").agg(
        F.min("order_timestamp").alias("order_timestamp"),
        F.sum("total_amount").alias("amount"),
        F.count(F.lit(1)).alias("lines"),
    )

    def early(c: Column) -> Column:
        return F.when(before, c)

    return (
        per_order.groupBy("customer_id")
        .agg(
            F.count_if(before).alias("orders"),
            F.sum(early(F.col("amount"))).cast("double").alias("spent"),
            F.sum(early(F.col("lines"))).alias("lines"),
            F.datediff(cut, F.max(early(ts))).alias("recency_days"),
            F.datediff(F.max(early(ts)), F.min(early(ts))).alias("tenure_days"),
            (F.count_if(after) == 0).cast("int").alias("churned"),
        )
        .where("orders > 0")
    )
