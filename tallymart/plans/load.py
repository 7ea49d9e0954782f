"""Warehouse load: CSV extracts to dimensions and the sales fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import customers as cust, products as prod, sales, warehouse
from ..sources.readers import read_extract
from ..sources.store import Store, merge_dimension, merge_fact
from ..sources.writers import write_csv_results


def build_star(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    translation: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The four dimensions and the fact as lazy frames."""
    if translation is not None:
        products = products.join(translation, "product_category_name", "left")
    return {
        "dim_date": warehouse.date_dimension(orders, "order_purchase_timestamp"),
        "dim_customer": warehouse.customer_dimension(customers),
        "dim_product": warehouse.product_dimension(products),
        "dim_seller": sellers,
        "fact_sales": warehouse.sales_fact(orders, items),
    }


# What identifies a row of each stored table.
KEYS = {
    "dim_date": "date_id",
    "dim_customer": "customer_id",
    "dim_product": "product_id",
    "dim_seller": "seller_id",
    "fact_sales": ["order_id", "order_item_id"],
}


def etl_run(
    spark: SparkSession,
    folder: str,
    target: str,
    translated: bool = True,
    chunk: str = "day",
    files: dict[str, str] | None = None,
) -> Store:
    """Read the extracts of a folder and merge them into the stored star schema.

    Rows of a key that is stored already replace the stored ones, all others
    are added, so extracts may overlap and a run may be repeated.  All five
    tables change at once: a run that fails leaves the old version, and of two
    runs at a time one raises ``Conflict``.

    ``files`` maps short names to file names where those differ.

    The source never sets the fact's date key and loads no sellers; here the
    fact carries ``order_date`` and the seller dimension is stored too.
    """
    files = files or {}
    frames = {
        n: read_extract(spark, folder, n, files.get(n))
        for n in ("customers", "orders", "order_items", "products", "sellers")
    }
    names = None
    if translated:
        names = read_extract(spark, folder, "category_translation", files.get("category_translation"))
    star = build_star(
        frames["customers"],
        frames["orders"],
        frames["order_items"],
        frames["products"],
        frames["sellers"],
        names,
    )
    store = Store(spark, target)
    with store.transaction() as change:
        for name, df in star.items():
            if name == "fact_sales":
                merge_fact(change, name, df, KEYS[name], "order_date", chunk)
            else:
                merge_dimension(change, name, df, KEYS[name])
    return store


def analysis_results(
    fact: DataFrame, dim_customer: DataFrame, dim_product: DataFrame, dim_seller: DataFrame, start, end
) -> dict[str, DataFrame]:
    """The five result sets of the sales analysis."""
    return {
        "daily_sales": sales.daily_sales(fact, start, end),
        "category_performance": prod.category_performance(fact, dim_product),
        "customer_segments": cust.customer_segments_geo(fact, dim_customer),
        "seller_performance": prod.seller_performance(fact, dim_seller),
        "rfm_analysis": cust.rfm_scores(fact, end),
    }


def store_analysis(results: dict[str, DataFrame], folder: str) -> None:
    write_csv_results(results, folder)


def register_views(frames: dict[str, DataFrame]) -> None:
    """Make frames available to SQL by name."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)

