"""Named queries: sales summaries, forecasts, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sales
from .registry import AS_OF, END, START, query, rounded
from .staging_sql import mean, total, with_staging

DAILY = f"""daily AS (
  SELECT order_date AS date, {total('total_amount')} AS revenue
  FROM fact_sales GROUP BY 1)"""

DAILY_YEAR = f"""daily AS (
  SELECT order_date AS date, {total('total_amount')} AS revenue
  FROM fact_sales WHERE order_date >= DATE '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1)"""

DAILY_SALES = f"""daily_sales AS (
  SELECT order_date AS date, COUNT(*) AS total_orders, {total('total_amount')} AS total_revenue,
    {mean('total_amount')} AS average_order_value
  FROM fact_sales WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1)"""


def daily(t, days=None):
    if days is not None:
        return sales.daily_revenue(t.fact_sales(), AS_OF, days)
    return t.fact_sales().groupBy(F.col("order_date").alias("date")).agg(
        F.sum("total_amount").cast("double").alias("revenue")
    )


@query("sales_summary", with_staging(f"""
SELECT CAST(o.order_purchase_timestamp AS DATE) AS date, COUNT(DISTINCT o.order_id) AS total_orders,
  {total('i.price')} AS total_revenue, COUNT(DISTINCT o.customer_id) AS unique_customers
FROM st_orders o JOIN st_items i ON o.order_id = i.order_id
WHERE o.order_purchase_timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
GROUP BY 1 ORDER BY 1"""))
def sales_summary(t):
    return sales.sales_summary(t.orders, t.order_items, START, END)


@query("daily_sales", with_staging("SELECT * FROM daily_sales ORDER BY date", DAILY_SALES))
def daily_sales(t):
    return sales.daily_sales(t.fact_sales(), START, END)


@query("q_daily_sales", with_staging(f"""
SELECT CAST(order_timestamp AS DATE) AS date, COUNT(DISTINCT order_id) AS total_orders,
  {total('total_amount')} AS total_revenue, COUNT(DISTINCT customer_id) AS unique_customers
FROM fact_sales WHERE order_timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
GROUP BY 1 ORDER BY 1"""))
def q_daily_sales(t):
    return sales.q_daily_sales(t.fact_sales(), START, END)


def _summary_v2(granularity, unit):
    sql = with_staging(f"""
SELECT d AS date, CAST(GROUPING(d) AS INT) AS is_total, {total('total_amount')} AS sales,
  COUNT(DISTINCT order_id) AS orders,
  CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT order_id) AS average_order_value
FROM (SELECT CAST(date_trunc('{unit}', order_date) AS DATE) AS d, order_id, total_amount FROM fact_sales)
GROUP BY ROLLUP (d)""")

    @query(f"sales_summary_v2_{granularity}", sql)
    def build(t):
        return sales.sales_summary_v2(t.fact_sales(), granularity)


for _name, _unit in sales.GRANULARITY.items():
    _summary_v2(_name, _unit)


@query("mv_daily_sales_summary", with_staging(f"""
SELECT d.date_id, d.year, d.month, d.day_of_week, COUNT(DISTINCT fs.order_id) AS total_orders,
  COUNT(DISTINCT fs.customer_id) AS unique_customers, {total('fs.total_amount')} AS total_revenue,
  {mean('fs.total_amount')} AS average_order_value,
  CAST(SUM(CASE WHEN fs.review_score >= 4 THEN 1 ELSE 0 END) AS DOUBLE)
    / NULLIF(COUNT(fs.review_score), 0) AS satisfaction_rate
FROM dim_date d LEFT JOIN fact_sales fs ON d.date_id = fs.order_date
GROUP BY 1, 2, 3, 4"""))
def mv_daily_sales_summary(t):
    return sales.mv_daily_sales_summary(t.dim_date, t.fact_sales(reviews=True))


@query("mv_monthly_category_performance", with_staging(f"""
SELECT d.year, d.month, p.product_category_name, COUNT(DISTINCT fs.order_id) AS total_orders,
  COUNT(DISTINCT fs.customer_id) AS unique_customers, {total('fs.total_amount')} AS total_revenue,
  {mean('fs.review_score')} AS average_review_score
FROM dim_date d JOIN fact_sales fs ON d.date_id = fs.order_date
JOIN st_products p ON fs.product_id = p.product_id GROUP BY 1, 2, 3"""))
def mv_monthly_category_performance(t):
    return sales.mv_monthly_category_performance(t.dim_date, t.fact_sales(reviews=True), t.products)


@query("mv_daily_sales_metrics", with_staging(f"""
SELECT CAST(o.order_purchase_timestamp AS DATE) AS date, COUNT(DISTINCT o.order_id) AS total_orders,
  COUNT(DISTINCT o.customer_id) AS unique_customers, {total('p.payment_value')} AS total_revenue
FROM st_orders o JOIN st_payments p ON o.order_id = p.order_id GROUP BY 1"""))
def mv_daily_sales_metrics(t):
    return sales.mv_daily_sales_metrics(t.orders, t.order_payments)


_CHANGE = "({c} - lag({c}) OVER (ORDER BY date)) / NULLIF(lag({c}) OVER (ORDER BY date), 0)"


@query("dashboard_kpis", with_staging(f"""
SELECT round(SUM(total_revenue), 2) AS total_revenue, round(AVG(dr), 8) AS revenue_change,
  CAST(SUM(total_orders) AS BIGINT) AS total_orders, round(AVG(dn), 8) AS orders_change,
  round(AVG(average_order_value), 4) AS average_order_value, round(AVG(dv), 8) AS average_order_value_change
FROM (SELECT *, {_CHANGE.format(c='total_revenue')} AS dr, {_CHANGE.format(c='total_orders')} AS dn,
  {_CHANGE.format(c='average_order_value')} AS dv FROM daily_sales)""", DAILY_SALES))
def dashboard_kpis(t):
    kpis = sales.dashboard_kpis(sales.daily_sales(t.fact_sales(), START, END))
    kpis = rounded(kpis, "revenue_change", "orders_change", "average_order_value_change", digits=8)
    return rounded(rounded(kpis, "average_order_value"), "total_revenue", digits=2)


_TREND = """model AS (
  SELECT MAX(date) AS last_date, COUNT(*) AS n, regr_slope(revenue, x) AS slope,
    regr_intercept(revenue, x) AS intercept, regr_syy(revenue, x) AS syy, regr_sxy(revenue, x) AS sxy
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY date) - 1 AS DOUBLE) AS x FROM daily))"""


@query("sales_forecast", with_staging("""
SELECT CAST(last_date + CAST(i + 1 AS INT) AS DATE) AS date,
  round(a.ma7 * 0.5 + a.ma30 * 0.3 + (slope * (n + i) + intercept) * 0.2, 3) AS forecasted_revenue,
  CAST(0 AS DOUBLE) AS confidence_lower, CAST(0 AS DOUBLE) AS confidence_upper
FROM model, (SELECT unnest(range(30)) AS i) g,
  (SELECT CASE WHEN COUNT(*) >= 7 THEN AVG(revenue) FILTER (rn <= 7) END AS ma7,
     CASE WHEN COUNT(*) >= 30 THEN AVG(revenue) FILTER (rn <= 30) END AS ma30
   FROM (SELECT revenue, row_number() OVER (ORDER BY date DESC) AS rn FROM daily)) a""", DAILY_YEAR, _TREND))
def sales_forecast(t):
    return rounded(sales.sales_forecast(t.fact_sales(), AS_OF), "forecasted_revenue", digits=3)


@query("moving_averages", with_staging("""
SELECT date, revenue,
  round(CASE WHEN COUNT(*) OVER w7 = 7 THEN AVG(revenue) OVER w7 END, 3) AS ma7,
  round(CASE WHEN COUNT(*) OVER w30 = 30 THEN AVG(revenue) OVER w30 END, 3) AS ma30
FROM daily WINDOW w7 AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w30 AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", DAILY))
def moving_averages(t):
    return rounded(sales.moving_averages(daily(t), "revenue"), "ma7", "ma30", digits=3)


@query("forecast_with_bounds", with_staging("""
SELECT CAST(last_date + CAST(i + 1 AS INT) AS DATE) AS date, round(line, 2) AS forecast,
  round(line - 1.96 * band, 2) AS lower_bound, round(line + 1.96 * band, 2) AS upper_bound
FROM (SELECT last_date, i, slope * (n + i) + intercept AS line,
    sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) AS band
  FROM model, (SELECT unnest(range(30)) AS i) g)""", DAILY, _TREND))
def forecast_with_bounds(t):
    out = sales.forecast_with_bounds(daily(t), 30)
    return rounded(out, "forecast", "lower_bound", "upper_bound", digits=2)


@query("sales_anomalies_zscore", with_staging("""
SELECT date, revenue, round((revenue - m) / s, 6) AS score, abs((revenue - m) / s) > 2 AS is_anomaly
FROM daily, (SELECT AVG(revenue) AS m, stddev_samp(revenue) AS s FROM daily)""", DAILY))
def sales_anomalies_zscore(t):
    return rounded(sales.sales_anomalies(daily(t), "zscore", 2.0), "score", digits=6)


@query("sales_anomalies_iqr", with_staging("""
SELECT date, revenue, round(over / (hi - lo), 6) AS score, over / (hi - lo) > 0.5 AS is_anomaly
FROM (SELECT date, revenue, lo, hi, greatest(lo - revenue, revenue - hi, 0) AS over
  FROM daily, (SELECT quantile_cont(revenue, 0.25) AS lo, quantile_cont(revenue, 0.75) AS hi FROM daily))""",
    DAILY))
def sales_anomalies_iqr(t):
    return rounded(sales.sales_anomalies(daily(t), "iqr", 0.5), "score", digits=6)


@query("forecast_by_category")
def forecast_by_category(t):
    """Months ahead of every category's revenue; a fold over a series is beyond plain SQL, tests compare it with one in Python."""
    lines = t.fact_sales().join(t.products.select("product_id", "product_category_name"), "product_id")
    return sales.seasonal_forecasts(lines, "product_category_name", "order_timestamp", "total_amount")
