"""Data quality rules, order stages and delivery times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..schemas import ORDER_STATUS, PAYMENT_TYPES

STAGES = {
    "approval": ("order_purchase_timestamp", "order_approved_at"),
    "handling": ("order_approved_at", "order_delivered_carrier_date"),
    "transit": ("order_delivered_carrier_date", "order_delivered_customer_date"),
    "total": ("order_purchase_timestamp", "order_delivered_customer_date"),
}


def referential_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    parents = parent.select(F.col(parent_key or key).alias(key))
    return child.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def check_rules(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it, in one pass.

    A rule is a condition that good rows meet; null counts as broken.
    """
    broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())]
    counts = df.agg(F.count(F.lit(1)).alias("checked"), *broken)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
            for i, name in enumerate(rules)
        ]
    )
    return counts.select(F.explode(rows).alias("r"), "checked").select(
        F.lit(table).alias("table_name"), "r.rule", "checked", "r.violations"
    )


def duplicate_rule(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"),
    ).select(F.lit(table).alias("table_name"), F.lit("unique " + ", ".join(keys)).alias("rule"), "checked", "violations")


def foreign_key_rule(child: DataFrame, table: str, key: str, parent: DataFrame) -> DataFrame:
    """Lines are counted per key first, so a hot key is one row in the join."""
    per = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(key).distinct().withColumn("_known", F.lit(True))
    return per.join(known, key, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("violations"),
    ).select(F.lit(table).alias("table_name"), F.lit(f"known {key}").alias("rule"), "checked", "violations")


def key_rules(
    parents: dict[str, tuple[DataFrame, str, list[str], bool]], children: list[tuple[DataFrame, str, str]]
) -> DataFrame:
    """Key and reference rules of several tables from one grouping of all their keys.

    ``parents``: domain to (table, its name, key columns, whether to report repeats);
    ``children``: (table, its name, key column that is also the domain).  Every
    table is read once; rows are summed per key before they meet.
    """
    # A key is counted in the places of its own domain only: first as a parent's, then for each child.
    number = {domain: i for i, domain in enumerate(parents)}
    users = {domain: [name for _, name, d in children if d == domain] for domain in parents}
    places = [f"n{i}" for i in range(1 + max(map(len, users.values()), default=0))]
    by_table: dict[int, tuple[DataFrame, list[Column]]] = {}

    def add(df: DataFrame, domain: str, place: int, key: Column, counted: Column) -> None:
        cell = F.struct(
            F.lit(number[domain]).alias("domain"), key.alias("key"),
            *[(F.when(counted, 1).otherwise(0) if i == place else F.lit(0)).cast("long").alias(n) for i, n in enumerate(places)],
        )
        by_table.setdefault(id(df), (df, []))[1].append(cell)

    for domain, (df, _, keys, _) in parents.items():
        add(df, domain, 0, F.concat_ws("\x00", *[F.col(k).cast("string") for k in keys]), F.lit(True))
    for df, name, domain in children:
        add(df, domain, 1 + users[domain].index(name), F.concat_ws("\x00", F.col(domain).cast("string")), F.col(domain).isNotNull())
    rows = reduce(
        DataFrame.unionAll,
        [df.select(F.explode(F.array(*cells)).alias("k")).select("k.*") for df, cells in by_table.values()],
    )
    per_key = rows.groupBy("domain", "key").agg(*[F.sum(n).alias(n) for n in places])
    zero, own = F.lit(0).cast("long"), F.col(places[0])
    total = lambda c: F.coalesce(F.sum(c), zero)
    rules = []
    for domain, (_, name, keys, report) in parents.items():
        if report:
            mine = (F.col("domain") == number[domain]) & (own > 0)
            rules.append((name, "unique " + ", ".join(keys), total(F.when(mine, own)), total(F.when(mine, own - 1))))
    for _, name, domain in children:
        mine, n = F.col("domain") == number[domain], F.col(places[1 + users[domain].index(name)])
        rules.append((name, f"known {domain}", total(F.when(mine, n)), total(F.when(mine & (own == 0), n))))
    counts = per_key.agg(*[c.alias(f"{w}{i}") for i, (_, _, a, b) in enumerate(rules) for w, c in (("c", a), ("v", b))])
    cells = [
        F.struct(F.lit(t).alias("table_name"), F.lit(r).alias("rule"), F.col(f"c{i}").alias("checked"), F.col(f"v{i}").alias("violations"))
        for i, (t, r, _, _) in enumerate(rules)
    ]
    return counts.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def data_quality_report(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """Null, range, category, order-of-stages, key and reference rules."""
    col = F.col
    parts = [
        check_rules(
            orders,
            "orders",
            {
                "order_id present": col("order_id").isNotNull(),
                "customer_id present": col("customer_id").isNotNull(),
                "order_status known": col("order_status").isin(ORDER_STATUS),
                "approved after purchase": col("order_approved_at") >= col("order_purchase_timestamp"),
                "carrier after approval": col("order_delivered_carrier_date") >= col("order_approved_at"),
                "delivered after carrier": col("order_delivered_customer_date") >= col("order_delivered_carrier_date"),
            },
        ),
        check_rules(
            items,
            "order_items",
            {
                "price present": col("price").isNotNull(),
                "price in 10..1000": col("price").between(10, 1000),
                "freight in 5..50": col("freight_value").between(5, 50),
            },
        ),
        check_rules(
            payments, "order_payments", {"payment_type known": col("payment_type").isin(PAYMENT_TYPES)}
        ),
        check_rules(reviews, "order_reviews", {"score in 1..5": col("review_score").between(1, 5)}),
        key_rules(
            {
                "order_id": (orders, "orders", ["order_id"], True),
                "line": (items, "order_items", ["order_id", "order_item_id"], True),
                "customer_id": (customers, "customers", ["customer_id"], False),
                "product_id": (products, "products", ["product_id"], False),
                "seller_id": (sellers, "sellers", ["seller_id"], False),
            },
            [
                (orders, "orders", "customer_id"),
                (items, "order_items", "order_id"),
                (items, "order_items", "product_id"),
                (items, "order_items", "seller_id"),
                (reviews, "order_reviews", "order_id"),
            ],
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def stage_hours(orders: DataFrame) -> DataFrame:
    """Orders with the hours spent in each stage."""
    hours = {
        f"{name}_hours": (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(3600)
        for name, (start, end) in STAGES.items()
    }
    return orders.select("order_id", "order_status", *[v.alias(k) for k, v in hours.items()])


def order_processing_stages(orders: DataFrame) -> DataFrame:
    """Per order status: orders and mean hours in each stage."""
    rows = stage_hours(orders)
    return rows.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.avg(f"{name}_hours").alias(f"avg_{name}_hours") for name in STAGES],
    )


def delivery_time_analysis(orders: DataFrame) -> DataFrame:
    """Per stage: median, 90th and 95th percentile of the hours, exact."""
    rows = stage_hours(orders)
    names = [f"{n}_hours" for n in STAGES]
    edges = exact_quantiles(rows, {n: [0.5, 0.9, 0.95] for n in names})
    packed = F.array(
        *[F.struct(F.lit(stage).alias("stage"), F.col(f"{stage}_hours").alias("q")) for stage in STAGES]
    )
    return edges.select(F.explode(packed).alias("s")).select(
        "s.stage",
        F.col("s.q")[0].alias("median_hours"),
        F.col("s.q")[1].alias("p90_hours"),
        F.col("s.q")[2].alias("p95_hours"),
    )
