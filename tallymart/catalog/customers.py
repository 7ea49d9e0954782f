"""Named queries: lifetime value, segments, RFM, cohorts, churn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import customers, models, warehouse
from .registry import AS_OF, END, START, query, rounded
from .staging_sql import mean, total, with_staging

BOUGHT = f"""bought AS (
  SELECT customer_id, SUM(total_amount) AS spent, COUNT(DISTINCT order_id) AS orders,
    {mean('total_amount')} AS line_value, MAX(order_timestamp) AS last_ts, MIN(order_timestamp) AS first_ts
  FROM fact_sales WHERE order_timestamp >= DATE '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1)"""


@query("customer_ltv", with_staging(f"""
SELECT b.customer_id, CAST(spent AS DOUBLE) AS total_spent, orders AS total_orders,
  line_value AS avg_order_value,
  CAST(spent AS DOUBLE) / NULLIF(date_sub('day', first_ts, last_ts), 0) * 365 AS annual_value,
  c.customer_segment, CAST(date_sub('day', last_ts, TIMESTAMP '{AS_OF}') AS INT) AS days_since_last_purchase
FROM bought b JOIN st_customers c ON b.customer_id = c.customer_id WHERE c.is_current""", BOUGHT))
def customer_ltv(t):
    return customers.customer_ltv(t.fact_sales(), t.customers, AS_OF)


@query("customer_ltv_per_order", with_staging("""
SELECT b.customer_id, CAST(spent AS DOUBLE) AS total_spent, CAST(spent AS DOUBLE) / orders AS avg_order_value
FROM bought b JOIN st_customers c ON b.customer_id = c.customer_id""", BOUGHT))
def customer_ltv_per_order(t):
    value = customers.customer_ltv(t.fact_sales(), t.customers, AS_OF, per_order=True)
    return value.select("customer_id", "total_spent", "avg_order_value")


@query("customer_ltv_v2", with_staging(f"""
SELECT f.customer_id, {total('total_amount')} AS ltv, COUNT(DISTINCT order_id) AS total_orders,
  CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT order_id) AS average_order_value,
  MIN(order_timestamp) AS first_order_date, MAX(order_timestamp) AS last_order_date
FROM fact_sales f JOIN st_customers c ON f.customer_id = c.customer_id
WHERE c.customer_segment = 'MACHINERY' GROUP BY 1 HAVING COUNT(DISTINCT order_id) >= 2
ORDER BY ltv DESC, f.customer_id LIMIT 100"""))
def customer_ltv_v2(t):
    return customers.customer_ltv_v2(t.fact_sales(), t.customers, "MACHINERY", 2)


@query("customer_segmentation", with_staging(f"""
SELECT segment, COUNT(*) AS customer_count, {mean('orders')} AS avg_frequency,
  round(AVG(line_value), 4) AS avg_order_value, {mean('spent')} AS avg_total_spent,
  {mean("date_sub('day', first_ts, last_ts)")} AS avg_customer_age_days
FROM (SELECT *, CASE WHEN orders > 10 AND spent > 1000 THEN 'VIP' WHEN orders > 5 AND spent > 500 THEN 'Loyal'
    WHEN orders > 2 AND spent > 200 THEN 'Regular'
    WHEN last_ts >= DATE '{AS_OF}' - INTERVAL 90 DAY THEN 'New' ELSE 'At Risk' END AS segment
  FROM bought) GROUP BY 1""", BOUGHT))
def customer_segmentation(t):
    return rounded(customers.customer_segmentation(t.fact_sales(), AS_OF), "avg_order_value")


GEO = f"""geo AS (
  SELECT customer_region, customer_city_size, COUNT(DISTINCT f.customer_id) AS total_customers,
    COUNT(*) AS total_orders, {total('total_amount')} AS total_revenue,
    {mean('total_amount')} AS average_order_value
  FROM fact_sales f JOIN st_customers c ON f.customer_id = c.customer_id GROUP BY 1, 2)"""


@query("customer_segments_geo", with_staging("SELECT * FROM geo", GEO))
def customer_segments_geo(t):
    return customers.customer_segments_geo(t.fact_sales(), t.customers)


@query("segment_treemap", with_staging("""
SELECT customer_region, customer_city_size, CAST(GROUPING(customer_region, customer_city_size) AS INT) AS level,
  round(SUM(total_revenue), 2) AS total_revenue
FROM geo GROUP BY ROLLUP (customer_region, customer_city_size)""", GEO))
def segment_treemap(t):
    tree = customers.segment_treemap(customers.customer_segments_geo(t.fact_sales(), t.customers))
    return rounded(tree, "total_revenue", digits=2)


def _edges(c: str) -> str:
    return ", ".join(f"quantile_cont({c}, {p}) AS {c[0]}{i}" for i, p in enumerate((0.2, 0.4, 0.6, 0.8), 1))


def _score(c: str, labels: tuple) -> str:
    cases = " ".join(f"WHEN {c} <= {c[0]}{i} THEN {labels[i - 1]}" for i in range(1, 5))
    return f"CASE {cases} ELSE {labels[4]} END"


RFM = f"""rfm_base AS (
  SELECT customer_id, MAX(order_date) AS last_purchase_date, COUNT(*) AS frequency,
    {total('total_amount')} AS monetary,
    CAST(date_diff('day', MAX(order_date), DATE '{AS_OF}') AS INT) AS recency
  FROM fact_sales GROUP BY 1),
rfm AS (
  SELECT b.*, {_score('recency', (5, 4, 3, 2, 1))} AS R_score, {_score('frequency', (1, 2, 3, 4, 5))} AS F_score,
    {_score('monetary', (1, 2, 3, 4, 5))} AS M_score
  FROM rfm_base b, (SELECT {_edges('recency')}, {_edges('frequency')}, {_edges('monetary')} FROM rfm_base)),
rfm_scored AS (
  SELECT *, CAST(R_score AS VARCHAR) || CAST(F_score AS VARCHAR) || CAST(M_score AS VARCHAR) AS RFM_score FROM rfm)"""

RFM_COLUMNS = "customer_id, last_purchase_date, frequency, monetary, recency, R_score, F_score, M_score, RFM_score"


@query("rfm_scores", with_staging(f"SELECT {RFM_COLUMNS} FROM rfm_scored", RFM))
def rfm_scores(t):
    return customers.rfm_scores(t.fact_sales(), AS_OF)


@query("rfm_segments", with_staging(f"""
SELECT {RFM_COLUMNS}, CASE WHEN R_score >= 4 AND F_score >= 4 AND M_score >= 4 THEN 'Champions'
  WHEN R_score >= 3 AND F_score >= 3 THEN 'Loyal Customers'
  WHEN R_score <= 2 AND F_score <= 2 THEN 'Lost' ELSE 'At Risk' END AS segment
FROM rfm_scored""", RFM))
def rfm_segments(t):
    return customers.rfm_segments(customers.rfm_scores(t.fact_sales(), AS_OF))


@query("rfm_histogram", with_staging(
    "SELECT RFM_score, COUNT(*) AS customers FROM rfm_scored GROUP BY 1", RFM))
def rfm_histogram(t):
    return customers.rfm_histogram(customers.rfm_scores(t.fact_sales(), AS_OF))


def _cohort(period: str):
    sql = with_staging(f"""
SELECT cohort_date, order_period, COUNT(DISTINCT o.customer_id) AS active_customers
FROM (SELECT customer_id, CAST(date_trunc('{period}', order_purchase_timestamp) AS DATE) AS order_period
    FROM st_orders) o
JOIN (SELECT customer_id, CAST(date_trunc('{period}', MIN(order_purchase_timestamp)) AS DATE) AS cohort_date
    FROM st_orders GROUP BY 1) f ON o.customer_id = f.customer_id
GROUP BY 1, 2""")

    @query(f"customer_cohort_{period}", sql)
    def build(t):
        return customers.customer_cohort(t.orders, period)


for _period in ("month", "week", "year"):
    _cohort(_period)


@query("q_customer_cohort", with_staging(f"""
SELECT CAST(fp.cohort_month AS DATE) AS cohort_month, COUNT(DISTINCT fs.customer_id) AS total_customers,
  {total('fs.total_amount')} AS total_revenue
FROM fact_sales fs JOIN (SELECT customer_id, MIN(date_trunc('month', order_timestamp)) AS cohort_month
  FROM fact_sales GROUP BY 1) fp ON fs.customer_id = fp.customer_id GROUP BY 1"""))
def q_customer_cohort(t):
    return customers.q_customer_cohort(t.fact_sales())


def _retention_sql(start: str, offset: str, head: str = "SELECT *", tail: str = "") -> str:
    return with_staging(f"""
{head} FROM (SELECT a.cohort_date, period_offset, active_customers, average_value, cohort_size,
  active_customers / cohort_size * 100 AS retention_rate
FROM (SELECT cohort_date, CAST({offset} AS INT) AS period_offset,
    COUNT(DISTINCT customer_id) AS active_customers,
    CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT customer_id) AS average_value
  FROM activity GROUP BY 1, 2) a
JOIN (SELECT cohort_date, COUNT(DISTINCT customer_id) AS cohort_size FROM activity GROUP BY 1) s
  ON a.cohort_date = s.cohort_date) {tail}""", f"""activity AS (
  SELECT customer_id, total_amount, p AS order_period, MIN(p) OVER (PARTITION BY customer_id) AS cohort_date
  FROM (SELECT customer_id, total_amount, {start} AS p FROM fact_sales))""")


def _retention(name: str, period, start: str, offset: str):
    @query(name, _retention_sql(start, offset))
    def build(t):
        return customers.cohort_retention(t.fact_sales(), period)


MONTH = ("CAST(date_trunc('month', order_date) AS DATE)", "date_diff('month', cohort_date, order_period)")
_retention("cohort_retention_month", "month", *MONTH)
_retention("cohort_retention_30_days", 30,
           "CAST(DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', order_date) / 30) * 30 AS INT) AS DATE)",
           "date_diff('day', cohort_date, order_period) / 30")


# Every offset that two months of the whole range can have.
MONTHS = (int(END[:4]) - int(START[:4])) * 12 + int(END[5:7]) - int(START[5:7]) + 1
OFFSETS = ", ".join(f'MAX(retention_rate) FILTER (period_offset = {i}) AS "{i}"' for i in range(MONTHS))


@query("retention_matrix", _retention_sql(*MONTH, f"SELECT cohort_date, cohort_size, {OFFSETS}", "GROUP BY 1, 2"))
def retention_matrix(t):
    return customers.retention_matrix(customers.cohort_retention(t.fact_sales()), list(range(MONTHS)))


@query("customer_spend", with_staging(f"""
SELECT c.customer_id, COUNT(DISTINCT o.order_id) AS total_orders, {total('i.price')} AS total_spent
FROM st_customers c JOIN st_orders o ON c.customer_id = o.customer_id
JOIN st_items i ON o.order_id = i.order_id GROUP BY 1"""))
def customer_spend(t):
    return customers.customer_spend(t.customers, t.orders, t.order_items)


@query("repeat_customers", with_staging(f"""
SELECT o.customer_id, COUNT(DISTINCT o.order_id) AS total_orders, {total('i.price')} AS total_spent
FROM st_orders o JOIN st_items i ON o.order_id = i.order_id WHERE o.order_status = 'delivered'
GROUP BY 1 HAVING COUNT(DISTINCT o.order_id) > 1"""))
def repeat_customers(t):
    return customers.repeat_customers(t.orders, t.order_items, "delivered")


@query("mv_customer_analytics", with_staging(f"""
SELECT c.customer_id, c.customer_state, COUNT(DISTINCT o.order_id) AS total_orders,
  {total('i.price')} AS total_spent, {mean('i.price')} AS avg_order_value,
  MIN(o.order_purchase_timestamp) AS first_purchase, MAX(o.order_purchase_timestamp) AS last_purchase,
  COUNT(DISTINCT p.product_category_name) AS unique_categories_bought
FROM st_customers c LEFT JOIN st_orders o ON c.customer_id = o.customer_id
LEFT JOIN st_items i ON o.order_id = i.order_id LEFT JOIN st_products p ON i.product_id = p.product_id
GROUP BY 1, 2"""))
def mv_customer_analytics(t):
    return customers.mv_customer_analytics(t.customers, t.orders, t.order_items, t.products)


CLV = f"""clv AS (
  SELECT customer_id, COUNT(DISTINCT order_id) AS orders, CAST(SUM(total_amount) AS DOUBLE) AS spent,
    MIN(order_date) AS first, MAX(order_date) AS last FROM fact_sales GROUP BY 1),
valued AS (
  SELECT customer_id, (spent / orders) * (orders / (greatest(date_diff('day', first, DATE '{AS_OF}') + 1, 1) / 365.0))
    * ((date_diff('day', first, last) + 1) / 365.0) / (1 + CAST(0.1 AS DOUBLE) - r) AS ltv
  FROM clv, (SELECT CAST(SUM(CASE WHEN orders > 1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS r FROM clv))"""


@query("clv_formula", with_staging("""
SELECT c.customer_id, round(coalesce(ltv, 0), 2) AS ltv
FROM st_customers c LEFT JOIN valued v ON c.customer_id = v.customer_id""", CLV))
def clv_formula(t):
    return rounded(customers.clv_formula(t.fact_sales(), t.customers, AS_OF), "ltv", digits=2)


@query("high_value_customers", with_staging("""
SELECT c.customer_id, round(ltv, 2) AS lifetime_value
FROM st_customers c JOIN valued v ON c.customer_id = v.customer_id WHERE ltv > 1000""", CLV))
def high_value_customers(t):
    value = customers.clv_formula(t.fact_sales(), t.customers, AS_OF)
    rich = warehouse.high_value_customers(value.withColumnRenamed("ltv", "lifetime_value"))
    return rounded(rich, "lifetime_value", digits=2)


CHURN_SQL = f"""
SELECT customer_id, COUNT(DISTINCT order_id) FILTER (early) AS orders,
  CAST(SUM(total_amount) FILTER (early) AS DOUBLE) AS spent, COUNT(*) FILTER (early) AS lines,
  CAST(date_diff('day', MAX(order_timestamp) FILTER (early), DATE '{AS_OF}' - INTERVAL 90 DAY) AS INT) AS recency_days,
  CAST(date_diff('day', MIN(order_timestamp) FILTER (early), MAX(order_timestamp) FILTER (early)) AS INT) AS tenure_days,
  CAST(CASE WHEN COUNT(*) FILTER (NOT early) = 0 THEN 1 ELSE 0 END AS INT) AS churned
FROM (SELECT *, order_timestamp < DATE '{AS_OF}' - INTERVAL 90 DAY AS early FROM fact_sales
  WHERE order_timestamp < DATE '{AS_OF}') GROUP BY 1 HAVING COUNT(*) FILTER (early) > 0"""


@query("churn_features", with_staging(CHURN_SQL))
def churn_features(t):
    return customers.churn_features(t.fact_sales(), AS_OF)


@query("churn_model", with_staging(f"""
SELECT customer_id, churned, CAST(orders AS DOUBLE) AS orders, spent, CAST(lines AS DOUBLE) AS lines,
  CAST(recency_days AS DOUBLE) AS recency_days, CAST(tenure_days AS DOUBLE) AS tenure_days,
  TRUE AS follows_score, TRUE AS optimal FROM ({CHURN_SQL})"""))
def churn_model(t):
    """Features and label as given, the decision follows the score, and the fit is at its optimum."""
    scored = models.churn_model(customers.churn_features(t.fact_sales(), AS_OF))
    follows = (F.col("churn_probability") > 0.5).cast("int") == F.col("predicted")
    return scored.select(
        "customer_id", "churned", *models.CHURN_FEATURES, follows.alias("follows_score"),
        models.is_optimal(scored).scalar().alias("optimal"),
    )


@query("kmeans_segments", with_staging(f"""
SELECT customer_id, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS frequency, {mean('total_amount')} AS avg_order_value,
  CAST(SUM(total_amount) AS DOUBLE) AS total_spent, TRUE AS is_nearest, TRUE AS is_settled
FROM fact_sales WHERE order_timestamp >= DATE '{AS_OF}' - INTERVAL 3650 DAY GROUP BY 1"""))
def kmeans_segments(t):
    """Features as given; every customer is in the nearest segment, and moving the centres gains nothing."""
    features = ["frequency", "avg_order_value", "total_spent"]
    metrics = customers.customer_metrics(t.fact_sales(), AS_OF, 3650)
    rows = models.kmeans_segments(metrics, features)
    return rows.select("customer_id", *features, "is_nearest", models.is_settled(rows, features).scalar().alias("is_settled"))


@query("churn_scores")
def churn_scores(t):
    """What the model says of each customer; whether that is right, ``churn_model`` compares."""
    return models.churn_model(customers.churn_features(t.fact_sales(), AS_OF)).select("customer_id", "churned", "churn_probability", "predicted")


@query("kmeans_rows")
def kmeans_rows(t):
    """Each customer's segment and distance; whether these are right, ``kmeans_segments`` compares."""
    metrics = customers.customer_metrics(t.fact_sales(), AS_OF, 3650)
    return models.kmeans_segments(metrics, ["frequency", "avg_order_value", "total_spent"]).select("customer_id", "segment", "distance")


@query("dim_customer_lifetime", with_staging(f"""
SELECT c.customer_id, c.customer_city, c.customer_state, c.customer_region, c.customer_city_size,
  c.customer_segment, c.is_current, MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
  COUNT(DISTINCT order_id) AS total_orders, coalesce({total('total_amount')}, 0) AS total_amount
FROM st_customers c LEFT JOIN fact_sales f ON c.customer_id = f.customer_id GROUP BY 1, 2, 3, 4, 5, 6, 7"""))
def dim_customer_lifetime(t):
    return warehouse.dim_customer_lifetime(t.customers, t.fact_sales())


@query("segmented_customers", with_staging(f"""
SELECT customer_id, orders AS frequency, CAST(spent AS DOUBLE) AS total_spent,
  CASE WHEN orders > 10 AND spent > 1000 THEN 'VIP' WHEN orders > 5 AND spent > 500 THEN 'Loyal'
    WHEN orders > 2 AND spent > 200 THEN 'Regular'
    WHEN last_ts >= DATE '{AS_OF}' - INTERVAL 90 DAY THEN 'New' ELSE 'At Risk' END AS segment
FROM bought""", BOUGHT))
def segmented_customers(t):
    rows = customers.segmented_customers(t.fact_sales(), AS_OF)
    return rows.select("customer_id", "frequency", F.col("total_spent").cast("double").alias("total_spent"), "segment")
