"""Named queries: writers, upserts, table upkeep and the warehouse load.

Each writes data derived from the given tables below the shared scratch folder
and reads it back.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..functions.dates import between_dates
from ..plans import load, marts
from ..plans.views import refresh_view
from ..schemas import CSV_FILES
from ..session import scratch_dir, stored
from ..sources import readers, writers
from ..sources.layout import write_clustered
from ..sources.store import Conflict, Store, merge_fact
from . import logs as _logs  # noqa: F401  its queries are used below
from .registry import END, QUERIES, SQL, START, query
from .sales import DAILY_SALES
from .staging_sql import total, with_staging
from .streams import CUSTOMER_MART, hourly, with_messages


@query("publish_json", with_staging(
    "SELECT order_id, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value FROM st_payments"))
def publish_json(t):
    folder = scratch_dir(t.spark, "topics")
    writers.publish_json(t.order_payments, "payments", "text", folder)
    schema = t.order_payments.withColumn("payment_value", F.col("payment_value").cast("double")).schema
    parsed = readers.good_rows(readers.parse_json(t.spark.read.text(f"{folder}/payments"), schema))
    return parsed.drop("payment_sequential")


@query("write_mart", with_messages("SELECT * FROM growth", CUSTOMER_MART))
def write_mart(t):
    """Written twice: a rerun replaces the dates it writes."""
    path = scratch_dir(t.spark, "mart")
    mart = marts.customer_growth_mart(hourly(t, "customers"))
    for _ in range(2):
        writers.write_mart(mart, path)
    return t.spark.read.parquet(path)


FACT_BY_DAY = with_staging(
    f"SELECT order_date, COUNT(*) AS lines, {total('total_amount')} AS amount FROM fact_sales GROUP BY 1")


def _by_day(df):
    return df.groupBy("order_date").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("total_amount").cast("double").alias("amount")
    )


@query("partition_by_time", FACT_BY_DAY)
def partition_by_time(t):
    path = scratch_dir(t.spark, "fact")
    writers.partition_by_time(t.fact_sales(), path, chunk="month")
    return _by_day(t.spark.read.parquet(path))


@query("clustered_fact", with_staging(f"""
SELECT 'customer' AS kind, customer_id AS id, COUNT(*) AS lines, {total('total_amount')} AS amount FROM fact_sales WHERE customer_id % 97 = 5 GROUP BY 2
UNION ALL SELECT 'seller', seller_id, COUNT(*), {total('total_amount')} FROM fact_sales WHERE seller_id = 7 GROUP BY 2"""))
def clustered_fact(t):
    """A fact laid out so that a customer or a seller is in few files of a chunk."""
    path = scratch_dir(t.spark, "clustered")
    write_clustered(t.fact_sales(), path, ["customer_id", "product_id", "seller_id"], chunk="month")
    fact = t.spark.read.parquet(path)
    figures = [F.count(F.lit(1)).alias("lines"), F.sum("total_amount").cast("double").alias("amount")]
    some = lambda kind, rows: rows.groupBy(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("long").alias("id")).agg(*figures)
    return some("customer", fact.where("customer_id % 97 = 5")).unionByName(some("seller", fact.where("seller_id = 7")))


@query("append_fact", FACT_BY_DAY)
def append_fact(t):
    path = scratch_dir(t.spark, "fact")
    fact = t.fact_sales()
    writers.append_fact(fact.where("is_returned"), path, chunk="month")
    writers.append_fact(fact.where("not is_returned"), path, chunk="month")
    return _by_day(t.spark.read.parquet(path))


@query("upsert_dimension", with_staging("""
SELECT customer_id, customer_region, CASE WHEN customer_region = 'EUROPE' THEN 'MOVED' ELSE customer_segment END
  AS customer_segment FROM st_customers"""))
def upsert_dimension(t):
    rows = t.customers.select("customer_id", "customer_region", "customer_segment")
    known = rows.where("customer_region <> 'AFRICA'")
    moved = rows.where("customer_region = 'EUROPE'").withColumn("customer_segment", F.lit("MOVED"))
    fresh = rows.where("customer_region = 'AFRICA'").unionByName(moved)
    return writers.upsert_dimension(known, fresh, "customer_id")


@query("refresh_materialized", with_staging(f"""
SELECT p.product_category_name, COUNT(*) AS lines, {total('total_amount')} AS amount
FROM fact_sales f JOIN st_products p ON f.product_id = p.product_id GROUP BY 1"""))
def refresh_materialized(t):
    view = (
        t.fact_sales()
        .join(t.products.select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("total_amount").cast("double").alias("amount"))
    )
    return writers.refresh_materialized(view, scratch_dir(t.spark, "view"))


def differ(one, other) -> bool:
    """Whether two frames of the same columns hold other rows as text, or a row another number of times; each is read once."""
    text = lambda df, n: df.select([F.col(c).cast("string") for c in df.columns]).withColumn("_n", F.lit(n))
    rows = text(one, 1).unionByName(text(other, -1))
    return not rows.groupBy(*one.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty()


@query("write_csv_results", with_staging("SELECT * FROM daily_sales", DAILY_SALES))
def write_csv_results(t):
    """All five results stored and read back: each must equal what was computed.

    All come from one fact, which is stored, as its join costs more than all the results.
    """
    folder = scratch_dir(t.spark, "results")
    results = load.analysis_results(stored(t.fact_sales(), "fact"), t.customers, t.products, t.sellers, START, END)
    for df in results.values():
        df.persist()  # made once, to be stored and to be compared
    try:
        load.store_analysis(results, folder)
        for name, df in results.items():
            if differ(df, readers.read_csv(t.spark, f"{folder}/{name}", df.schema)):
                raise ValueError(f"{name} differs after it was stored")
    finally:
        for df in results.values():
            df.unpersist()
    return readers.read_csv(t.spark, f"{folder}/daily_sales", results["daily_sales"].schema)


@query("write_json_report", SQL["daily_log_report"])
def write_json_report(t):
    """The log report of a day as JSON rows, read back."""
    folder = scratch_dir(t.spark, "reports")
    report = QUERIES["daily_log_report"](t)
    writers.write_json_report(report, folder, "daily_log_report")
    return t.spark.read.schema(report.schema).json(f"{folder}/daily_log_report")


@query("read_query", with_staging(
    f"SELECT order_status, COUNT(*) AS orders FROM st_orders "
    f"WHERE order_purchase_timestamp >= TIMESTAMP '1998-01-01' GROUP BY 1"))
def read_query(t):
    load.register_views({"tallymart_orders": t.orders})
    return readers.read_query(
        t.spark,
        "SELECT order_status, COUNT(*) AS orders FROM tallymart_orders "
        "WHERE order_purchase_timestamp >= :since GROUP BY order_status",
        since=dt.datetime.fromisoformat("1998-01-01"),
    )


@query("read_table", with_staging("SELECT seller_id, seller_city, seller_state FROM st_sellers"))
def read_table(t):
    load.register_views({"tallymart_sellers": t.sellers})
    return readers.read_table(t.spark, "tallymart_sellers")


@query("read_access_log", with_staging("""
SELECT date_trunc('second', "timestamp") AS "timestamp", CAST(user_id AS VARCHAR) AS user_id, 'GET' AS method,
  endpoint, status_code, CAST(response_time AS DOUBLE) AS response_time FROM logs"""))
def read_access_log(t):
    path = scratch_dir(t.spark, "access")
    t.logs.select(
        F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss Z").alias("time_local"),
        F.col("ip_address").alias("remote_addr"),
        F.col("user_id").cast("string").alias("remote_user"),
        F.concat(F.lit("GET "), F.col("endpoint"), F.lit(" HTTP/1.1")).alias("request"),
        F.col("status_code").cast("string").alias("status"),
        F.col("response_time").cast("string").alias("request_time"),
    ).write.json(path)
    rows = readers.read_access_log(t.spark, path)
    return rows.select("timestamp", "user_id", "method", "endpoint", "status_code", "response_time")


@query("read_application_log", with_staging("""
SELECT date_trunc('second', "timestamp") + INTERVAL 250 MILLISECOND AS "timestamp", level, message,
  service AS logger FROM logs"""))
def read_application_log(t):
    path = scratch_dir(t.spark, "application")
    t.logs.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss',250'").alias("timestamp"),
        "level",
        F.col("service").alias("logger"),
        "message",
    ).write.json(path)
    return readers.read_application_log(t.spark, path).select("timestamp", "level", "message", "logger")


def write_extracts(t, folder: str) -> None:
    """The given tables as the CSV extracts that the load reads.

    They are packed, as plain text would be a third of all that a load moves.  A packed file
    is read by one task, so it has a bounded number of rows.
    """
    frames = {
        "customers": t.customers,
        "orders": t.orders,
        "order_items": t.order_items.withColumn("shipping_limit_date", F.col("item_delivered_date")),
        "products": t.products,
        "sellers": t.sellers,
    }
    for name, df in frames.items():
        file, schema = CSV_FILES[name]
        cells = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        writers.write_csv_results({file: df.select(*cells)}, folder, compression="gzip", maxRecordsPerFile="500000")


@query("etl_run", with_staging("""
SELECT CAST(i.order_id AS VARCHAR) AS order_id, i.order_item_id, CAST(o.customer_id AS VARCHAR) AS customer_id,
  CAST(i.product_id AS VARCHAR) AS product_id, CAST(o.order_purchase_timestamp AS DATE) AS order_date,
  CAST(i.price + i.freight_value AS DOUBLE) AS total_amount,
  CAST(floor((epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_estimated_delivery_date))
    / 86400000000.0) AS INT) AS delivery_delay_days
FROM st_items i JOIN st_orders o ON i.order_id = o.order_id"""))
def etl_run(t):
    folder, target = scratch_dir(t.spark, "extracts"), scratch_dir(t.spark, "star")
    write_extracts(t, folder)
    fact = load.etl_run(t.spark, folder, target, translated=False, chunk="month").read("fact_sales")
    return fact.select(
        "order_id",
        "order_item_id",
        "customer_id",
        "product_id",
        "order_date",
        F.col("total_amount").cast("double").alias("total_amount"),
        "delivery_delay_days",
    )


def _star_rows(store):
    """All five stored tables as rows of table, key and two cells."""
    text = lambda c: F.col(c).cast("string")
    cells = {
        "dim_date": (text("date_id"), text("month"), text("day_name")),
        "dim_customer": (text("customer_id"), text("customer_city"), text("customer_state")),
        "dim_product": (text("product_id"), text("product_category_name"), text("product_weight_g").cast("int").cast("string")),
        "dim_seller": (text("seller_id"), text("seller_city"), text("seller_state")),
        "fact_sales": (F.concat_ws("-", "order_id", "order_item_id"), text("customer_id"), text("order_date")),
    }
    frames = [
        store.read(name).select(F.lit(name).alias("stored"), k.alias("key"), a.alias("a"), b.alias("b"))
        for name, (k, a, b) in cells.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), frames)


STAR_ROWS = with_staging("""
SELECT DISTINCT 'dim_date' AS stored, strftime(order_purchase_timestamp, '%Y-%m-%d') AS key,
  CAST(month(order_purchase_timestamp) AS VARCHAR) AS a, strftime(order_purchase_timestamp, '%A') AS b FROM st_orders
UNION ALL SELECT 'dim_customer', CAST(customer_id AS VARCHAR), customer_city, customer_state FROM st_customers
UNION ALL SELECT 'dim_product', CAST(product_id AS VARCHAR), product_category_name,
  CAST(CAST(product_weight_g AS INT) AS VARCHAR) FROM st_products
UNION ALL SELECT 'dim_seller', CAST(seller_id AS VARCHAR), seller_city, seller_state FROM st_sellers
UNION ALL SELECT 'fact_sales', CAST(i.order_id AS VARCHAR) || '-' || CAST(i.order_item_id AS VARCHAR),
  CAST(o.customer_id AS VARCHAR), strftime(o.order_purchase_timestamp, '%Y-%m-%d')
  FROM st_items i JOIN st_orders o ON i.order_id = o.order_id""")


def _rerun(name: str, chunk: str):
    @query(name, STAR_ROWS)
    def build(t):
        """Two extracts: orders up to a day within a month, then from two months before it on, half of the others."""
        target = scratch_dir(t.spark, "star")
        cut, back = "1998-01-16", "1997-11-16"
        day = F.to_date("order_purchase_timestamp")
        half = lambda df, key, r: df.where(F.pmod(F.xxhash64(key), F.lit(3)) != r)  # noqa: E731  a third in both
        # Lines meet their orders once for both extracts; an order that is there twice is in an extract by any of its days.
        days = t.orders.groupBy("order_id").agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
        items = stored(t.order_items.join(days, "order_id"), "items")
        for r, mine, theirs in ((0, day < cut, F.col("_first") < cut), (1, day >= back, F.col("_last") >= back)):
            orders = t.orders.where(mine)
            part = SimpleNamespace(
                customers=half(t.customers, "customer_id", r), products=half(t.products, "product_id", r),
                sellers=half(t.sellers, "seller_id", r), orders=orders,
                order_items=items.where(theirs).drop("_first", "_last"),
            )
            folder = scratch_dir(t.spark, "extracts")
            write_extracts(part, folder)
            store = load.etl_run(t.spark, folder, target, translated=False, chunk=chunk)
        return _star_rows(store)


_rerun("etl_rerun_day", "day")
_rerun("etl_rerun_month", "month")


@query("views_incremental", with_staging(f"""
SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_date_month, product_category_name, COUNT(DISTINCT order_id) AS total_orders,
  COUNT(DISTINCT customer_id) AS unique_customers, {total('total_amount')} AS total_revenue
FROM (SELECT f.* REPLACE (CASE WHEN f.order_id % 10 = 3 THEN order_date + 40 ELSE order_date END AS order_date), p.product_category_name
  FROM fact_sales f JOIN st_products p ON f.product_id = p.product_id WHERE f.order_id % 10 <> 7 OR f.order_date < DATE '1996-01-01')
GROUP BY 1, 2"""))
def views_incremental(t):
    """A view by month and category over a fact that gets new, moved and removed rows; each refresh computes changed months."""
    store = Store(t.spark, scratch_dir(t.spark, "star"))
    keys, last = ["order_id", "order_item_id"], F.col("order_id") % 10
    fact = t.fact_sales().select(*keys, "customer_id", "product_id", "total_amount", F.to_date("order_date").alias("order_date"))

    def view(rows):
        lines = rows.join(store.read("products"), "product_id")
        by = ["order_date_month", "product_category_name"]
        return (
            lines.groupBy(*by, "order_id", "customer_id").agg(F.sum("total_amount").alias("amount"))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("total_orders"), F.countDistinct("customer_id").alias("unique_customers"), F.sum("amount").cast("double").alias("total_revenue"))
        )

    with store.transaction() as change:
        change.replace("products", t.products.select("product_id", "product_category_name"))
        merge_fact(change, "fact", fact.where(last != 3), keys, chunk="month")
    refresh = lambda: refresh_view(store, "by_category", "fact", view, ("products",))
    refresh()
    moved = fact.where(last == 3).withColumn("order_date", F.date_add("order_date", 40))
    with store.transaction() as change:  # these come late, and to another month
        merge_fact(change, "fact", moved, keys, chunk="month")
    refresh()
    stale = [c for c in store.manifest()["tables"]["fact"]["chunks"] if c >= "1996-01-01"]
    with store.transaction() as change:  # rows are taken back from some months
        rows = change.read("fact", stale)
        change.replace_chunks("fact", rows.where((F.col("order_id") % 10 != 7)), "order_date_month", stale)
    if sorted(refresh()) != sorted(stale) or refresh():
        raise ValueError("a refresh computed other months than those that changed")
    return store.read("by_category")


@query("etl_crash_safe", with_staging("""
SELECT order_id, CAST(order_item_id AS INT) AS order_item_id, CASE WHEN pmod2 = 0 THEN NULL ELSE order_date END AS order_date,
  CAST(total_amount AS DOUBLE) + CASE WHEN pmod2 = 1 THEN 1 ELSE 0 END AS amount
FROM (SELECT *, order_id % 3 AS pmod2 FROM fact_sales)"""))
def etl_crash_safe(t):
    """A fact with rows that have no date, merged; a run lost before it is published and one that was overtaken change nothing."""
    store = Store(t.spark, scratch_dir(t.spark, "star"))
    third = F.col("order_id") % 3
    fact = t.fact_sales().select(
        "order_id", F.col("order_item_id").cast("int").alias("order_item_id"), F.when(third != 0, F.col("order_date")).alias("order_date"),
        F.col("total_amount").cast("double").alias("amount"),
    )
    keys, moved = ["order_id", "order_item_id"], F.when(third == 1, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount")
    with store.transaction() as change:
        merge_fact(change, "fact", fact, keys, chunk="month")
    lost = store.transaction()
    change = lost.__enter__()
    merge_fact(change, "fact", fact.withColumn("amount", F.lit(-1.0)), keys, chunk="month")  # never published
    try:
        with store.transaction() as slow:
            slow.replace("fact", fact.limit(0))
            with store.transaction() as fast:  # some rows change, some come anew
                merge_fact(fast, "fact", fact.where(third != 2).select(*keys, "order_date", moved), keys, chunk="month")
    except Conflict:
        return store.read("fact").select(*keys, "order_date", "amount")
    raise ValueError("a writer that was overtaken has published")


@query("store_dimension", with_staging("""
SELECT customer_id, customer_region, CASE WHEN customer_region = 'EUROPE' THEN 'MOVED' ELSE customer_segment END
  AS customer_segment FROM st_customers"""))
def store_dimension(t):
    """The merge of ``upsert_dimension`` stored, twice."""
    rows = t.customers.select("customer_id", "customer_region", "customer_segment")
    path = scratch_dir(t.spark, "dimension")
    writers.store_dimension(rows.where("customer_region <> 'AFRICA'"), path, "customer_id")
    moved = rows.where("customer_region = 'EUROPE'").withColumn("customer_segment", F.lit("MOVED"))
    for _ in range(2):
        writers.store_dimension(rows.where("customer_region = 'AFRICA'").unionByName(moved), path, "customer_id")
    return t.spark.read.parquet(path)


@query("read_fact_range", with_staging("""
SELECT order_date, COUNT(*) AS lines, CAST(SUM(total_amount) AS DOUBLE) AS amount FROM fact_sales
WHERE order_timestamp BETWEEN TIMESTAMP '1997-03-10 06:00:00' AND TIMESTAMP '1997-06-20 18:00:00' GROUP BY 1"""))
def read_fact_range(t):
    """A range of a stored fact; only the months that it touches are read."""
    path = scratch_dir(t.spark, "fact")
    writers.partition_by_time(t.fact_sales(), path, chunk="month")
    return _by_day(between_dates(t.spark.read.parquet(path), "order_timestamp", "1997-03-10 06:00:00", "1997-06-20 18:00:00"))


@query("read_csv", with_staging("SELECT CAST(seller_id AS VARCHAR) AS seller_id, seller_city, seller_state FROM st_sellers"))
def read_csv(t):
    folder = scratch_dir(t.spark, "extracts")
    cells = t.sellers.select(
        F.col("seller_id").cast("string"), F.lit("00000").alias("seller_zip_code_prefix"), "seller_city", "seller_state"
    )
    writers.write_csv_results({CSV_FILES["sellers"][0]: cells}, folder)
    return readers.read_extract(t.spark, folder, "sellers").drop("seller_zip_code_prefix")


@query("drop_expired", with_staging("""
SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS order_date_month, COUNT(*) AS orders
FROM st_orders
WHERE date_trunc('month', order_purchase_timestamp) + INTERVAL 1 MONTH > DATE '2001-08-02' - INTERVAL 365 DAY
GROUP BY 1"""))
def drop_expired(t):
    """Months beyond the retention leave a stored, partitioned table."""
    name = "tallymart_expiring"
    t.spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = scratch_dir(t.spark, "expiring")
    rows = t.orders.select("order_id", F.to_date("order_purchase_timestamp").alias("order_date"))
    rows, part = writers.with_chunk(rows, "order_date", "month")
    writers.by_time(rows, part).write.partitionBy(part).option("path", path).saveAsTable(name)
    writers.drop_expired(t.spark, name, part, dt.date.fromisoformat("2001-08-02"), 365, "month")
    left = t.spark.table(name).groupBy(part).agg(F.count(F.lit(1)).alias("orders")).collect()
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.createDataFrame(left, "order_date_month date, orders long")  # a row per kept month
