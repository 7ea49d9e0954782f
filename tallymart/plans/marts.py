"""Daily marts from the hourly lake tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.aggregates import mean, ratio
from ..sources.landing import is_landed, read_landed
from ..sources.readers import in_range
from ..sources.store import Store
from ..sources.writers import write_mart

MONTH = "date_month"


def _day() -> Column:
    return F.to_date("window.start").alias("date")


def growth_days(customers: DataFrame) -> DataFrame:
    """New customers per day."""
    return customers.groupBy(_day()).agg(F.sum("count").alias("new_customers"))


def growth_of(days: DataFrame) -> DataFrame:
    """Days with the running total, which sees one row per day."""
    return days.withColumn("total_customers", F.sum("new_customers").over(W.orderBy("date")))


def customer_growth_mart(customers: DataFrame) -> DataFrame:
    """New customers per day and their running total."""
    return growth_of(growth_days(customers))


def _exact(c: str, scale: int) -> Column:
    """A stored double as a decimal: sums then do not depend on row order, so
    a rerun gives the same digits."""
    return F.col(c).cast(f"decimal(24,{scale})")


def sales_days(sales: DataFrame, weighted: bool = False) -> DataFrame:
    """Sales per day; ``all`` is the exact sum of revenue and freight."""
    revenue, freight = F.sum(_exact("total_sales", 2)), F.sum(_exact("total_freight", 2))
    price = ratio(revenue, F.sum("total_items")) if weighted else mean(_exact("avg_price", 6))
    return sales.groupBy(_day()).agg(
        revenue.cast("double").alias("daily_revenue"),
        F.sum("total_items").alias("total_items"),
        price.alias("average_item_price"),
        freight.cast("double").alias("total_freight"),
        (revenue + freight).cast("decimal(38,2)").alias("all"),
    )


def sales_of(days: DataFrame) -> DataFrame:
    """Days with the mean of the last seven rows."""
    last_seven = W.orderBy("date").rowsBetween(-6, 0)
    trend = ratio(F.sum("all").over(last_seven), F.count("all").over(last_seven))
    return days.withColumn("revenue_7day_avg", trend).withColumn(
        "total_revenue", F.col("all").cast("double")
    ).drop("all")


def sales_trends_mart(sales: DataFrame, weighted: bool = False) -> DataFrame:
    """Daily sales with the mean of the last seven rows.

    ``average_item_price`` is the mean of the hourly means as in the source;
    ``weighted=True`` weights the hours by their items.
    """
    return sales_of(sales_days(sales, weighted))


def order_performance_mart(orders: DataFrame, weighted: bool = False) -> DataFrame:
    """Daily orders, delay and orders per customer.

    ``avg_delivery_delay`` is the mean of the hourly means as in the source;
    ``weighted=True`` weights the hours by their orders.
    ``unique_customers`` adds up hourly counts as in the source: a customer
    seen in two hours counts twice.  ``exact_daily_customers`` is the sibling.
    """
    hourly = _exact("avg_delivery_delay", 6)
    delay = mean(hourly)
    if weighted:
        known = F.when(F.col("avg_delivery_delay").isNotNull(), F.col("total_orders"))
        delay = ratio(F.sum(hourly * known), F.sum(known))
    daily = orders.groupBy(_day()).agg(
        F.sum("total_orders").alias("daily_orders"),
        delay.alias("avg_delivery_delay"),
        F.sum("unique_customers").alias("unique_customers"),
    )
    return daily.withColumn(
        "orders_per_customer", ratio(F.col("daily_orders"), F.col("unique_customers"))
    )


def exact_daily_customers(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Customers per day at order grain, each once."""
    return orders.groupBy(F.to_date(ts).alias("date")).agg(
        F.countDistinct("customer_id").alias("unique_customers_exact")
    )


# Lake table, its figures per day, and what those become with the days before them.
MARTS = {
    "customer_growth_mart": ("customers", growth_days, growth_of),
    "sales_trends_mart": ("sales", sales_days, sales_of),
    "order_performance_mart": ("orders", order_performance_mart, lambda days: days),
}
STATE = "_state"


def lake_hours(spark: SparkSession, lake: str, table: str, start: dt.date, end: dt.date, strict_end: bool = False) -> DataFrame:
    """Hours of a lake table in a range; of a table landed by day, only the days in it are read."""
    if is_landed(spark, lake, table):
        # A window that starts the day before may reach into the range's first day, but is not in it.
        hours = read_landed(spark, lake, table, start, end)
    else:
        hours = spark.read.parquet(f"{lake.rstrip('/')}/{table}")
    return in_range(hours, start, end, strict_end)


def _months(first: dt.date, end: dt.date) -> list[str]:
    """First days of the months that the days from ``first`` to before ``end`` lie in."""
    out, month = [], first.replace(day=1)
    while month < end:
        out.append(month.isoformat())
        month = (month + dt.timedelta(days=32)).replace(day=1)
    return out


def process_all_marts(
    spark: SparkSession,
    lake: str,
    target: str,
    as_of: dt.date,
    days_ago: int = 1,
    strict_end: bool = False,
) -> list[str]:
    """Compute the three marts and store the requested days.

    The figures of every day are kept, a row each, in a store beside the marts.  A run
    reads the lake from the last day that is known there, or from the first requested day
    if that is earlier, and takes running totals and moving averages from the kept days;
    the first run reads the whole history up to ``as_of``.  Written are the requested days,
    those since the last known one, and all later ones, so a late day, asked for with an
    earlier ``as_of``, changes what follows from it too.  Writing a day again replaces it.
    The first failure stops the run.
    """
    if days_ago < 1:
        raise ValueError("days_ago starts at 1")
    start = as_of - dt.timedelta(days=days_ago)
    target = target.rstrip("/")
    store = Store(spark, f"{target}/{STATE}")
    paths = []
    for name, (table, days_of, mart_of) in MARTS.items():
        known = store.read(name).agg(F.max("date")).first()[0] if name in store.tables() else None
        first = dt.date(1970, 1, 1) if known is None else min(start, known)
        fresh = days_of(lake_hours(spark, lake, table, first, as_of, strict_end)).withColumn(MONTH, F.trunc("date", "month"))
        with store.transaction() as change:
            if known is None:
                change.replace(name, fresh, MONTH)
            else:
                months = _months(first, as_of)
                inside = (F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(as_of))
                kept = change.read(name, months).where(~inside)
                change.replace_chunks(name, kept.unionByName(fresh), MONTH, months)
        mart = mart_of(store.read(name).drop(MONTH))
        path = f"{target}/{name}"
        written = start if known is None else min(start, known + dt.timedelta(days=1))
        write_mart(mart.where(F.col("date") >= F.lit(written)), path)
        paths.append(path)
    return paths
