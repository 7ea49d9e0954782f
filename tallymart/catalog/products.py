"""Named queries: categories, products, sellers, baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baskets, products, warehouse
from .registry import AS_OF, END, START, query, rounded
from .staging_sql import mean, total, with_staging

RANGE = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query("product_performance", with_staging(f"""
SELECT p.product_category_name, COUNT(DISTINCT i.order_id) AS total_orders, {total('i.price')} AS total_revenue,
  {mean('r.review_score')} AS avg_rating
FROM st_products p JOIN st_items i ON p.product_id = i.product_id JOIN st_orders o ON i.order_id = o.order_id
LEFT JOIN st_reviews r ON o.order_id = r.order_id WHERE o.order_purchase_timestamp {RANGE} GROUP BY 1"""))
def product_performance(t):
    return products.product_performance(t.orders, t.order_items, t.products, t.order_reviews, START, END)


@query("seller_analytics", with_staging(f"""
SELECT s.seller_id, s.seller_city, s.seller_state, COUNT(DISTINCT i.order_id) AS total_orders,
  {total('i.price')} AS total_revenue, {mean('r.review_score')} AS avg_rating,
  COUNT(DISTINCT p.product_category_name) AS unique_categories
FROM st_sellers s JOIN st_items i ON s.seller_id = i.seller_id JOIN st_orders o ON i.order_id = o.order_id
JOIN st_products p ON i.product_id = p.product_id LEFT JOIN st_reviews r ON o.order_id = r.order_id
WHERE o.order_purchase_timestamp {RANGE} GROUP BY 1, 2, 3"""))
def seller_analytics(t):
    return products.seller_analytics(
        t.orders, t.order_items, t.products, t.sellers, t.order_reviews, START, END
    )


CATEGORY = f"""category AS (
  SELECT product_category_name_english, COUNT(*) AS total_sales, {total('total_amount')} AS total_revenue,
    {mean('price')} AS average_price, {mean('shipping_days')} AS average_shipping_days
  FROM fact_sales f JOIN st_products p ON f.product_id = p.product_id GROUP BY 1)"""


@query("category_performance", with_staging("SELECT * FROM category", CATEGORY))
def category_performance(t):
    return products.category_performance(t.fact_sales(), t.products)


@query("top_categories", with_staging("""
SELECT product_category_name_english, total_revenue FROM category
ORDER BY total_revenue DESC, product_category_name_english LIMIT 10""", CATEGORY))
def top_categories(t):
    return products.top_categories(products.category_performance(t.fact_sales(), t.products))


@query("q_product_performance", with_staging(f"""
SELECT p.product_category_name, COUNT(DISTINCT fs.order_id) AS total_orders,
  {total('fs.total_amount')} AS total_revenue, {mean('fs.total_amount')} AS avg_order_value,
  COUNT(DISTINCT fs.customer_id) AS unique_customers
FROM fact_sales fs JOIN st_products p ON fs.product_id = p.product_id
WHERE fs.order_timestamp {RANGE} GROUP BY 1"""))
def q_product_performance(t):
    return products.q_product_performance(t.fact_sales(), t.products, START, END)


@query("q_seller_performance", with_staging(f"""
SELECT s.seller_id, s.seller_city, COUNT(DISTINCT fs.order_id) AS total_orders,
  {total('fs.total_amount')} AS total_revenue, {mean('fs.delivery_delay_days')} AS avg_delivery_delay,
  {mean('fs.review_score')} AS avg_review_score
FROM fact_sales fs JOIN st_sellers s ON fs.seller_id = s.seller_id
WHERE fs.order_timestamp {RANGE} GROUP BY 1, 2"""))
def q_seller_performance(t):
    return products.q_seller_performance(t.fact_sales(reviews=True), t.sellers, START, END)


@query("seller_performance", with_staging(f"""
SELECT s.seller_id, s.seller_city, s.seller_state, COUNT(*) AS total_orders,
  {total('total_amount')} AS total_revenue, {mean('delivery_delay_days')} AS average_delivery_delay
FROM fact_sales f JOIN st_sellers s ON f.seller_id = s.seller_id GROUP BY 1, 2, 3"""))
def seller_performance(t):
    return products.seller_performance(t.fact_sales(), t.sellers)


@query("product_performance_v2", with_staging(f"""
SELECT f.product_id, {total('total_amount')} AS revenue, COUNT(*) AS units_sold,
  {mean('review_score')} AS average_rating,
  CAST(SUM(CASE WHEN is_returned THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS return_rate,
  p.product_category_name AS category
FROM fact_sales f JOIN st_products p ON f.product_id = p.product_id GROUP BY 1, p.product_category_name
ORDER BY revenue DESC, f.product_id LIMIT 100"""))
def product_performance_v2(t):
    return products.product_performance_v2(t.fact_sales(reviews=True), t.products)


@query("mv_product_performance", with_staging(f"""
SELECT p.product_id, p.product_category_name, COUNT(DISTINCT i.order_id) AS total_orders,
  {total('i.price')} AS total_revenue, {mean('i.price')} AS avg_price, {total('i.freight_value')} AS total_freight,
  COUNT(DISTINCT o.customer_id) AS unique_customers
FROM st_products p LEFT JOIN st_items i ON p.product_id = i.product_id
LEFT JOIN st_orders o ON i.order_id = o.order_id GROUP BY 1, 2"""))
def mv_product_performance(t):
    return products.mv_product_performance(t.products, t.order_items, t.orders)


_SCALED = "coalesce(({m} - MIN({m}) OVER ()) / NULLIF(MAX({m}) OVER () - MIN({m}) OVER (), 0), 0)"


@query("product_score", with_staging(f"""
SELECT product_id, revenue, round(margin, 8) AS margin, round(growth, 6) AS growth, return_rate,
  round(0.4 * {_SCALED.format(m='revenue')} + 0.3 * {_SCALED.format(m='margin')}
    + 0.2 * {_SCALED.format(m='growth')} - 0.1 * {_SCALED.format(m='return_rate')}, 6) AS score
FROM (SELECT product_id, {total('total_amount')} AS revenue,
    CAST(SUM(price * (1 - discount)) AS DOUBLE) / NULLIF(CAST(SUM(price) AS DOUBLE), 0) AS margin,
    coalesce((CAST(SUM(price) FILTER (recent) AS DOUBLE) - CAST(SUM(price) FILTER (earlier) AS DOUBLE))
      / NULLIF(CAST(SUM(price) FILTER (earlier) AS DOUBLE), 0), 0) AS growth,
    CAST(SUM(CASE WHEN is_returned THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS return_rate
  FROM (SELECT *, order_timestamp >= DATE '{AS_OF}' - INTERVAL 365 DAY AS recent,
      order_timestamp < DATE '{AS_OF}' - INTERVAL 365 DAY
        AND order_timestamp >= DATE '{AS_OF}' - INTERVAL 730 DAY AS earlier FROM fact_sales)
  GROUP BY 1)"""))
def product_score(t):
    scored = products.product_score(t.fact_sales(), AS_OF)
    return rounded(rounded(scored, "growth", "score", digits=6), "margin", digits=8)


@query("product_recommendations", with_staging(f"""
SELECT found.item AS recommended_product_id, shelf.product_category_name, found.hits AS co_purchase_count,
  line_price AS avg_price, line_score AS avg_rating
FROM (SELECT item, CAST(SUM(openings) AS BIGINT) AS hits FROM (
    SELECT late.product_id AS item,
      (SELECT COUNT(*) FROM begun WHERE begun.buyer = late.customer_id
        AND late.order_timestamp > begun.moment AND late.order_timestamp <= begun.moment + INTERVAL 30 DAY) AS openings
    FROM fact_sales late) WHERE openings > 0 GROUP BY item) found
JOIN (SELECT * FROM st_products WHERE is_current) shelf ON shelf.product_id = found.item
JOIN (SELECT product_id AS item, {mean('price')} AS line_price, {mean('review_score')} AS line_score
  FROM fact_sales GROUP BY product_id) figures ON figures.item = found.item
ORDER BY hits DESC, line_score DESC NULLS LAST, found.item LIMIT 10""", """begun AS (
  SELECT customer_id AS buyer, order_timestamp AS moment FROM fact_sales
  WHERE product_id = 1 AND 1 IN (SELECT product_id FROM st_products WHERE is_current))"""))
def product_recommendations(t):
    return baskets.product_recommendations(t.fact_sales(reviews=True), t.products, 1)


@query("recommend_for_customer", with_staging("""
SELECT product_id, COUNT(DISTINCT order_id) AS score FROM fact_sales
WHERE order_id IN (SELECT order_id FROM fact_sales
    WHERE product_id IN (SELECT product_id FROM fact_sales WHERE customer_id = 1))
  AND product_id NOT IN (SELECT product_id FROM fact_sales WHERE customer_id = 1)
GROUP BY 1 ORDER BY score DESC, product_id LIMIT 10"""))
def recommend_for_customer(t):
    return baskets.recommend_for_customer(t.fact_sales(), 1, 10)


# Per order and category the smallest and the largest product, orders in all and per category.
SHELVES = """shelves AS (
  SELECT order_id AS basket, product_category_name AS kind, bool_or(is_current) AS live,
    MIN(product_id) FILTER (is_current) AS low, MAX(product_id) FILTER (is_current) AS high
  FROM fact_sales JOIN st_products USING (product_id) GROUP BY 1, 2),
baskets AS (SELECT COUNT(DISTINCT order_id) AS total FROM fact_sales),
sizes AS (SELECT kind, COUNT(*) FILTER (live) AS held FROM shelves GROUP BY kind)"""


def _pair_sql(names: str, condition: str, least_support: float, least_confidence: float) -> str:
    return with_staging(f"""
SELECT category1, category2, together / total AS support, together / one.held AS confidence_1_2,
  together / two.held AS confidence_2_1, together AS pair_count
FROM (SELECT {names}, COUNT(*) AS together FROM shelves x JOIN shelves y USING (basket) WHERE {condition} GROUP BY 1, 2) pairs
CROSS JOIN baskets JOIN sizes one ON one.kind = category1 JOIN sizes two ON two.kind = category2
WHERE together / total >= {least_support}
  AND greatest(together / one.held, together / two.held) >= {least_confidence}""", SHELVES)


@query("market_basket", _pair_sql("x.kind AS category1, y.kind AS category2", "x.low < y.high", 0.01, 0.05))
def market_basket(t):
    return baskets.market_basket(t.fact_sales(), t.products, 0.01, 0.05)


@query("market_basket_unordered", _pair_sql(
    "x.kind AS category1, y.kind AS category2", "x.kind < y.kind", 0.01, 0.1))
def market_basket_unordered(t):
    return baskets.market_basket(t.fact_sales(), t.products, oriented=False)


RULES = """b AS (
  SELECT DISTINCT order_id, product_category_name AS item
  FROM st_items i JOIN st_products p ON i.product_id = p.product_id),
total AS (SELECT COUNT(DISTINCT order_id) AS n FROM b),
one AS (SELECT item, COUNT(*) AS k FROM b GROUP BY 1),
two AS (
  SELECT x.item AS i1, y.item AS i2, COUNT(*) AS k FROM b x JOIN b y ON x.order_id = y.order_id AND x.item < y.item
  GROUP BY 1, 2),
three AS (
  SELECT x.item AS i1, y.item AS i2, z.item AS i3, COUNT(*) AS k
  FROM b x JOIN b y ON x.order_id = y.order_id AND x.item < y.item
  JOIN b z ON z.order_id = y.order_id AND y.item < z.item GROUP BY 1, 2, 3),
rules AS (
  SELECT i1 AS antecedent, i2 AS consequent, two.k, one.k AS ka FROM two JOIN one ON item = i1
  UNION ALL SELECT i2, i1, two.k, one.k FROM two JOIN one ON item = i2
  UNION ALL SELECT t.i1 || '|' || t.i2, t.i3, t.k, two.k FROM three t JOIN two ON two.i1 = t.i1 AND two.i2 = t.i2
  UNION ALL SELECT t.i1 || '|' || t.i3, t.i2, t.k, two.k FROM three t JOIN two ON two.i1 = t.i1 AND two.i2 = t.i3
  UNION ALL SELECT t.i2 || '|' || t.i3, t.i1, t.k, two.k FROM three t JOIN two ON two.i1 = t.i2 AND two.i2 = t.i3)"""


@query("association_rules", with_staging("""
SELECT antecedent, consequent, round(r.k / n, 8) AS support, round(r.k / ka, 8) AS confidence,
  round((r.k / ka) / (one.k / n), 6) AS lift
FROM rules r, total, one WHERE one.item = consequent AND r.k / n >= 0.01 AND r.k / ka >= 0.1""", RULES))
def association_rules(t):
    lines = t.order_items.select("order_id", "product_id").join(t.products, "product_id")
    rules = baskets.association_rules(lines, "product_category_name", 0.01, 0.1)
    flat = rules.select(
        F.array_join("antecedent", "|").alias("antecedent"),
        F.col("consequent")[0].alias("consequent"),
        "support",
        "confidence",
        "lift",
    )
    return rounded(rounded(flat, "support", "confidence", digits=8), "lift", digits=6)


@query("dim_seller_lifetime", with_staging(f"""
SELECT s.seller_id, s.seller_city, s.seller_state, MIN(order_date) AS first_sale_date,
  MAX(order_date) AS last_sale_date, COUNT(f.order_id) AS total_sales,
  coalesce({total('total_amount')}, 0) AS total_revenue, {mean('review_score')} AS seller_rating
FROM st_sellers s LEFT JOIN fact_sales f ON s.seller_id = f.seller_id GROUP BY 1, 2, 3"""))
def dim_seller_lifetime(t):
    return warehouse.dim_seller_lifetime(t.sellers, t.fact_sales(reviews=True))
