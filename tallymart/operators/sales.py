"""Sales summaries, forecasts and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.aggregates import mean, ratio, total
from ..functions.checks import require
from ..functions.dates import between_dates, lookback, optional_date_filter

GRANULARITY = {"daily": "day", "weekly": "week", "monthly": "month"}


def order_totals(items: DataFrame) -> DataFrame:
    """Price per order: lines meet their order already summed."""
    return items.groupBy("order_id").agg(F.sum("price").alias("price"))


def sales_summary(orders: DataFrame, items: DataFrame, start=None, end=None) -> DataFrame:
    """Per day: orders, revenue and customers, over orders that have lines.

    At order grain an order is one row, so orders need no distinct count.
    """
    sold = optional_date_filter(orders, "order_purchase_timestamp", start, end)
    return (
        sold.select("order_id", "customer_id", "order_purchase_timestamp")
        .join(order_totals(items), "order_id")
        .groupBy(F.to_date("order_purchase_timestamp").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            total("price").alias("total_revenue"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
        .orderBy("date")
    )


def daily_sales(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Per date: lines, revenue, average line value."""
    return (
        optional_date_filter(fact, "order_date", start, end)
        .groupBy(F.col("order_date").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            total("total_amount").alias("total_revenue"),
            mean("total_amount").alias("average_order_value"),
        )
        .orderBy("date")
    )


def order_grain(fact: DataFrame, *keys: str) -> DataFrame:
    """Fact rows summed to one row per order (and key)."""
    return fact.groupBy(*keys, "order_id", "customer_id").agg(
        F.sum("total_amount").alias("amount"), F.count(F.lit(1)).alias("lines")
    )


def q_daily_sales(fact: DataFrame, start, end) -> DataFrame:
    """Per date: orders, revenue, customers."""
    rows = between_dates(fact, "order_timestamp", start, end)
    return (
        order_grain(rows, "order_date")
        .groupBy(F.col("order_date").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            total("amount").alias("total_revenue"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
        .orderBy("date")
    )


def sales_summary_v2(fact: DataFrame, granularity: str = "daily", start=None, end=None) -> DataFrame:
    """Series by period, and a total row whose ``date`` is null."""
    if granularity not in GRANULARITY:
        raise ValueError(f"granularity must be one of {sorted(GRANULARITY)}")
    period = F.to_date(F.date_trunc(GRANULARITY[granularity], "order_date"))
    rows = optional_date_filter(fact, "order_date", start, end)
    return (
        order_grain(rows, "order_date")
        .withColumn("date", period)
        .rollup("date")
        .agg(
            F.grouping("date").cast("int").alias("is_total"),
            total("amount").alias("sales"),
            F.count(F.lit(1)).alias("orders"),
            ratio(F.sum("amount"), F.count(F.lit(1))).alias("average_order_value"),
        )
    )


def mv_daily_sales_summary(dim_date: DataFrame, fact: DataFrame) -> DataFrame:
    """Every calendar date with its sales; dates without sales are kept."""
    scored = F.col("review_score").isNotNull().cast("int")
    pleased = (F.col("review_score") >= 4).cast("int")
    day = (
        fact.groupBy("order_date", "order_id", "customer_id")
        .agg(
            F.sum("total_amount").alias("amount"),
            F.count(F.lit(1)).alias("lines"),
            F.sum(scored).alias("scored"),
            F.sum(pleased).alias("pleased"),
        )
        .groupBy(F.col("order_date").alias("date_id"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.countDistinct("customer_id").alias("unique_customers"),
            total("amount").alias("total_revenue"),
            ratio(F.sum("amount"), F.sum("lines")).alias("average_order_value"),
            ratio(F.sum("pleased"), F.sum("scored")).alias("satisfaction_rate"),
        )
    )
    return (
        dim_date.select("date_id", "year", "month", "day_of_week")
        .join(day, "date_id", "left")
        .fillna(0, subset=["total_orders", "unique_customers"])
    )


def mv_monthly_category_performance(dim_date: DataFrame, fact: DataFrame, products: DataFrame) -> DataFrame:
    # A calendar holds one row per day, so it is small whatever the sales.
    day = F.broadcast(dim_date.select(F.col("date_id").alias("order_date"), "year", "month"))
    lines = fact.join(products.select("product_id", "product_category_name"), "product_id").join(
        day, "order_date"
    )
    keys = ["year", "month", "product_category_name"]
    return (
        lines.groupBy(*keys, "order_id", "customer_id")
        .agg(
            F.sum("total_amount").alias("amount"),
            F.sum("review_score").alias("score"),
            F.count("review_score").alias("scored"),
        )
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.countDistinct("customer_id").alias("unique_customers"),
            total("amount").alias("total_revenue"),
            ratio(F.sum("score"), F.sum("scored")).alias("average_review_score"),
        )
    )


def mv_daily_sales_metrics(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders joined with their payments, per day."""
    paid = payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    return (
        orders.select("order_id", "customer_id", "order_purchase_timestamp")
        .join(paid, "order_id")
        .groupBy(F.to_date("order_purchase_timestamp").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.countDistinct("customer_id").alias("unique_customers"),
            total("paid").alias("total_revenue"),
        )
    )


def dashboard_kpis(daily: DataFrame) -> DataFrame:
    """Totals and mean day-over-day change of the daily series.

    The series holds one row per day, so its order fits one task.
    """
    by_date = W.orderBy("date")

    def change(c: str):
        before = F.lag(c).over(by_date)
        return ratio(F.col(c) - before, before)

    measures = ["total_revenue", "total_orders", "average_order_value"]
    steps = daily.withColumns({f"d_{c}": change(c) for c in measures})
    return steps.agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("d_total_revenue").alias("revenue_change"),
        F.sum("total_orders").alias("total_orders"),
        F.avg("d_total_orders").alias("orders_change"),
        F.avg("average_order_value").alias("average_order_value"),
        F.avg("d_average_order_value").alias("average_order_value_change"),
    )


def moving_averages(daily: DataFrame, value: str, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Mean of the last n rows by date, null before n rows exist."""
    out = {}
    for n in spans:
        frame = W.orderBy("date").rowsBetween(1 - n, 0)
        full = F.count(value).over(frame) == n
        out[f"ma{n}"] = F.when(full, F.avg(value).over(frame))
    return daily.withColumns(out)


def daily_revenue(fact: DataFrame, as_of, days: int = 365) -> DataFrame:
    return (
        lookback(fact, "order_date", days, as_of)
        .groupBy(F.col("order_date").alias("date"))
        .agg(total("total_amount").alias("revenue"))
    )


def _trend(daily: DataFrame) -> DataFrame:
    """One row: last date, row count, and the least-squares line over 0..n-1."""
    x = F.row_number().over(W.orderBy("date")) - 1
    return daily.withColumn("x", x.cast("double")).agg(
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("revenue", "x").alias("slope"),
        F.regr_intercept("revenue", "x").alias("intercept"),
        F.regr_syy("revenue", "x").alias("syy"),
        F.regr_sxy("revenue", "x").alias("sxy"),
    )


def _horizon(row: DataFrame, periods: int) -> DataFrame:
    """The one-row model repeated for steps 0 .. periods - 1."""
    steps = F.sequence(F.lit(0), F.lit(periods - 1))
    return row.where("n > 0").withColumn("i", F.explode(steps)).withColumn(
        "date", F.date_add("last_date", F.col("i") + 1)
    )


def sales_forecast(fact: DataFrame, as_of, days: int = 30, history_days: int = 365) -> DataFrame:
    """0.5 MA7 + 0.3 MA30 + 0.2 trend; bounds stay 0 as in the source.

    Null where fewer than 30 days have sales.
    """
    require(fact, "order_date", "total_amount")
    daily = daily_revenue(fact, as_of, history_days)
    averages = moving_averages(daily, "revenue").agg(
        F.max_by("ma7", "date").alias("ma7"), F.max_by("ma30", "date").alias("ma30")
    )
    model = _trend(daily).withColumn("ma", averages.select(F.struct("ma7", "ma30")).scalar())
    line = F.col("slope") * (F.col("n") + F.col("i")) + F.col("intercept")
    return _horizon(model, days).select(
        "date",
        (F.col("ma.ma7") * 0.5 + F.col("ma.ma30") * 0.3 + line * 0.2).alias("forecasted_revenue"),
        F.lit(0.0).alias("confidence_lower"),
        F.lit(0.0).alias("confidence_upper"),
    )


def forecast_with_bounds(daily: DataFrame, periods: int = 30, z: float = 1.96) -> DataFrame:
    """Trend line with a residual band: lower <= forecast <= upper.

    ``daily`` holds ``date`` and ``revenue``.  A flat line with no band is
    given where a slope does not exist (a single day).
    """
    model = _trend(daily)
    slope = F.coalesce("slope", F.lit(0.0))
    base = F.coalesce("intercept", F.lit(0.0))
    spare = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    band = F.coalesce(
        F.sqrt(F.try_divide(spare, F.when(F.col("n") > 2, (F.col("n") - 2).cast("double")))),
        F.lit(0.0),
    )
    only = F.when(F.col("n") == 1, F.lit(daily.agg(F.max("revenue")).scalar()))
    line = F.coalesce(only, slope * (F.col("n") + F.col("i")) + base)
    return _horizon(model, periods).select(
        "date",
        line.alias("forecast"),
        (line - band * z).alias("lower_bound"),
        (line + band * z).alias("upper_bound"),
    )


def sales_anomalies(daily: DataFrame, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Flag and score each day by z-score, or by distance beyond the quartiles.

    The score statistics are one row, read as scalars.
    """
    x = F.col("revenue")
    if method == "zscore":
        stats = daily.agg(F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))).scalar()
        scored = daily.withColumn("_s", stats)
        score = F.try_divide(x - F.col("_s.m"), F.col("_s.s"))
        return scored.select(
            "date", "revenue", score.alias("score"),
            F.coalesce(F.abs(score) > threshold, F.lit(False)).alias("is_anomaly"),
        )
    if method == "iqr":
        # Quartiles of one row per day, a small series.
        q = daily.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))).scalar()
        scored = daily.withColumn("_q", q)
        low, high = F.col("_q")[0], F.col("_q")[1]
        over = F.greatest(low - x, x - high, F.lit(0.0))
        score = F.try_divide(over, high - low)
        return scored.select(
            "date", "revenue", score.alias("score"),
            F.coalesce(score > threshold, F.lit(False)).alias("is_anomaly"),
        )
    raise ValueError("method must be zscore or iqr")


# Smoothing weights of level, trend and season that are tried for every series.
WEIGHTS = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1, 0.3) for g in (0.1, 0.3, 0.6)]


def seasonal_forecasts(series: DataFrame, key: str, date: str, value: str, step: str = "month", season: int = 12, periods: int = 6, z: float = 1.96) -> DataFrame:
    """Additive Holt-Winters forecasts of many series: ``(key, date, forecast, lower, upper)``.

    A series has a value for every ``step`` from its first date to its last, 0 where there
    is none, so it is one short array; all series are folded in parallel.  Level, trend and
    season start from the first two seasons.  Of the weights in ``WEIGHTS``, those with the
    least sum of squared one-step errors after two seasons count; the bounds are ``z``
    times the root of its mean, growing with the root of the distance.  A series of less
    than two seasons and one step has no forecast.
    """
    every = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[step]
    at = F.date_trunc(step, date)
    held = series.where(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(F.col(key).alias("_key"), at.alias("_at")).agg(F.sum(value).cast("double").alias("_v"))
    grid = held.groupBy("_key").agg(F.explode(F.sequence(F.min("_at"), F.max("_at"), F.expr(every))).alias("_at"))
    whole = grid.join(held, ["_key", "_at"], "left").groupBy("_key").agg(
        F.max("_at").alias("_end"), F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_v", F.lit(0.0)).alias("v")))).alias("_rows")
    )
    values = whole.select("_key", "_end", F.transform("_rows", lambda r: r["v"]).alias("y")).where(F.size("y") > 2 * season)
    total = lambda y, start: F.aggregate(F.slice(y, start, season), F.lit(0.0), lambda x, v: x + v) / season

    def fold(y: Column, a: Column, b: Column, g: Column) -> Column:
        level, later = total(y, 1), total(y, season + 1)
        begin = F.struct(
            F.lit(0.0).alias("sse"), F.lit(season).alias("t"), level.alias("level"), ((later - level) / season).alias("trend"),
            F.transform(F.slice(y, 1, season), lambda v: v - level).alias("s"),
        )

        def move(state: Column, v: Column) -> Column:
            place = state["t"] % season
            s = F.get(state["s"], place)
            error = v - (state["level"] + state["trend"] + s)
            up = a * (v - s) + (1 - a) * (state["level"] + state["trend"])
            slope = b * (up - state["level"]) + (1 - b) * state["trend"]
            return F.struct(
                (state["sse"] + F.when(state["t"] >= 2 * season, error * error).otherwise(0.0)).alias("sse"), (state["t"] + 1).alias("t"),
                up.alias("level"), slope.alias("trend"),
                F.transform(state["s"], lambda x, i: F.when(i == place, g * (v - up) + (1 - g) * s).otherwise(x)).alias("s"),
            )

        return F.aggregate(F.slice(y, F.lit(season + 1), F.size(y)), begin, move)

    tried = F.array(*[F.struct(*[F.lit(float(w)).alias(n) for n, w in zip("abg", weights)]) for weights in WEIGHTS])
    best = values.withColumn("best", F.array_min(F.transform(tried, lambda w: fold(F.col("y"), w["a"], w["b"], w["g"]))))
    ahead = best.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"))
    middle = F.col("best.level") + F.col("h") * F.col("best.trend") + F.get("best.s", (F.col("best.t") + F.col("h") - 1) % season)
    width = z * F.sqrt(F.col("best.sse") / (F.size("y") - 2 * season) * F.col("h"))
    months = {"day": F.make_interval(days=F.col("h")), "week": F.make_interval(weeks=F.col("h")), "month": F.make_interval(months=F.col("h"))}[step]
    return ahead.select(
        F.col("_key").alias(key), (F.col("_end") + months).alias("date"), middle.alias("forecast"), (middle - width).alias("lower"), (middle + width).alias("upper")
    )
