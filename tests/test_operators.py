import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymart.operators import baskets, customers, logs, models, products, quality, sales, warehouse

FACT = (
    "order_id string, customer_id int, product_id int, order_timestamp timestamp, "
    "total_amount decimal(12,2), price decimal(12,2), review_score int"
)


@pytest.fixture
def fact(rows):
    def make(*lines):
        df = rows(
            FACT,
            *[(o, c, p, ts, *[__import__("decimal").Decimal(str(x))] * 2, None) for o, c, p, ts, x in lines],
        )
        return df.withColumn("order_date", F.to_date("order_timestamp"))

    return make


def by(df, key):
    return {r[key]: r for r in df.collect()}


# ---- customers ----------------------------------------------------------

def test_segments_cover_every_rule(fact):
    lines = [(f"v{i}", 1, 1, f"2024-01-{i + 1:02d}", 100) for i in range(12)]  # VIP
    lines += [(f"l{i}", 2, 1, f"2024-01-{i + 1:02d}", 100) for i in range(6)]  # Loyal
    lines += [(f"r{i}", 3, 1, f"2024-01-{i + 1:02d}", 100) for i in range(3)]  # Regular
    lines += [("n1", 4, 1, "2024-01-20", 5), ("a1", 5, 1, "2023-05-01", 5), ("x1", 6, 1, "2020-01-01", 5)]
    got = by(customers.segmented_customers(fact(*lines), "2024-02-01"), "customer_id")
    assert {c: r.segment for c, r in got.items()} == {
        1: "VIP", 2: "Loyal", 3: "Regular", 4: "New", 5: "At Risk"
    }
    summary = by(customers.customer_segmentation(fact(*lines), "2024-02-01"), "segment")
    assert summary["VIP"].customer_count == 1 and summary["VIP"].avg_total_spent == 1200.0


def test_ltv_of_a_single_day_is_null(fact, rows):
    dim = rows("customer_id int, customer_segment string, is_current boolean", (1, "A", True), (2, "B", True), (3, "C", False))
    df = fact(("a", 1, 1, "2024-01-01", 10), ("b", 2, 1, "2024-01-01", 10), ("c", 2, 1, "2024-01-11", 30), ("d", 3, 1, "2024-01-11", 99))
    got = by(customers.customer_ltv(df, dim, "2024-01-31"), "customer_id")
    assert set(got) == {1, 2}
    assert got[1].annual_value is None
    assert got[2].annual_value == pytest.approx(40 / 10 * 365)
    assert got[2].days_since_last_purchase == 20


def test_clv_is_finite_and_keeps_every_customer(fact, rows):
    dim = rows("customer_id int", (1,), (2,), (3,))
    df = fact(
        ("a", 1, 1, "2024-01-01", 100), ("b", 1, 2, "2024-01-02", 150),
        ("c", 2, 1, "2024-01-03", 200), ("d", 2, 3, "2024-01-04", 1e9),
    )
    got = by(customers.clv_formula(df, dim, "2024-02-01"), "customer_id")
    assert len(got) == 3 and all(0 <= r.ltv < float("inf") for r in got.values())
    assert got[3].ltv == 0


def test_rfm_survives_customers_who_ordered_once(fact):
    df = fact(*[(f"o{c}", c, 1, f"2024-01-{c:02d}", c) for c in range(1, 21)])
    got = by(customers.rfm_scores(df, "2024-02-01"), "customer_id")
    assert {r.F_score for r in got.values()} == {1}
    assert got[20].R_score == 5 and got[1].R_score == 1 and got[20].M_score == 5
    assert got[20].RFM_score == "515"
    named = by(customers.rfm_segments(customers.rfm_scores(df, "2024-02-01")), "customer_id")
    assert named[1].segment == "Lost"


def test_cohorts_follow_the_first_purchase(fact, rows):
    df = fact(
        ("a", 1, 1, "2024-01-05", 10), ("b", 1, 1, "2024-03-05", 20), ("c", 2, 1, "2024-01-09", 10), ("d", 3, 1, "2024-02-01", 5)
    )
    got = {(str(r.cohort_date), r.period_offset): r for r in customers.cohort_retention(df).collect()}
    assert got["2024-01-01", 0].retention_rate == 100.0
    assert got["2024-01-01", 2].retention_rate == 50.0 and got["2024-01-01", 2].average_value == 20.0
    assert got["2024-02-01", 0].cohort_size == 1
    orders = df.withColumn("order_purchase_timestamp", F.col("order_timestamp"))
    pairs = {(str(r.cohort_date), str(r.order_period)): r.active_customers for r in customers.customer_cohort(orders).collect()}
    assert pairs == {("2024-01-01", "2024-01-01"): 2, ("2024-01-01", "2024-03-01"): 1, ("2024-02-01", "2024-02-01"): 1}
    matrix = by(customers.retention_matrix(customers.cohort_retention(df), [0, 1, 2]), "cohort_date")
    assert matrix[dt.date(2024, 1, 1)]["2"] == 50.0 and matrix[dt.date(2024, 1, 1)]["1"] is None


def test_churn_label(fact):
    df = fact(
        ("a", 1, 1, "2024-01-01", 10), ("b", 1, 1, "2024-05-20", 10),
        ("c", 2, 1, "2024-01-01", 10), ("d", 3, 1, "2024-05-25", 10),
    )
    got = by(customers.churn_features(df, "2024-06-01", 90), "customer_id")
    assert {c: r.churned for c, r in got.items()} == {1: 0, 2: 1}
    assert got[1].orders == 1


def test_models(spark):
    near = [(i, float(i % 5), 10.0 + i % 5, i % 2) for i in range(50)]
    far = [(100 + i, 100.0 + i % 5, 500.0, 1) for i in range(50)]
    df = spark.createDataFrame(near + far, "customer_id int, a double, b double, churned int")
    got = by(models.kmeans_segments(df, ["a", "b"], n_segments=2), "customer_id")
    assert len(got) == 100
    assert len({got[i].segment for i in range(50)}) == 1 and got[0].segment != got[100].segment
    scored = models.churn_model(df, ["a", "b"]).collect()
    assert len(scored) == 100 and all(0 <= r.churn_probability <= 1 for r in scored)


# ---- baskets ------------------------------------------------------------

@pytest.mark.parametrize("slice_rows", [1_000_000, 2])
def test_recommendations_match_brute_force(fact, rows, monkeypatch, slice_rows):
    """The small slice size forces the split that a hot customer takes."""
    monkeypatch.setattr(baskets, "SLICE_ROWS", slice_rows)
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    lines = []
    for o in range(150):
        c = 1 if rng.random() < 0.5 else rng.randint(2, 6)  # one customer holds half of the rows
        ts = start + dt.timedelta(days=rng.randint(0, 120), hours=rng.choice([0, 0, 12]))
        for _ in range(rng.randint(1, 3)):
            lines.append((f"o{o}", c, rng.randint(1, 8), ts, rng.randint(1, 50)))
    want = Counter()
    for a, b in itertools.product(lines, lines):
        if a[1] == b[1] and a[0] != b[0] and a[2] == 3 and a[3] < b[3] <= a[3] + dt.timedelta(days=30) and b[2] != 8:
            want[b[2]] += 1
    dim = rows("product_id int, product_category_name string, is_current boolean", *[(p, f"c{p}", p != 8) for p in range(1, 9)])
    df = fact(*[(o, c, p, ts.isoformat(sep=" "), x) for o, c, p, ts, x in lines])
    got = baskets.product_recommendations(df, dim, 3).collect()
    assert {r.recommended_product_id: r.co_purchase_count for r in got} == dict(want)
    assert [r.co_purchase_count for r in got] == sorted(want.values(), reverse=True)


def test_market_basket_matches_brute_force(fact, rows):
    rng = random.Random(11)
    cats = {p: f"c{p % 4}" for p in range(1, 13)}
    lines = [(f"o{o}", 1, rng.randint(1, 12), "2024-01-01", 1) for o in range(60) for _ in range(rng.randint(1, 5))]
    lines += [("hot", 1, p, "2024-01-01", 1) for p in range(1, 13) for _ in range(20)]
    dim = rows("product_id int, product_category_name string, is_current boolean", *[(p, c, True) for p, c in cats.items()])
    orders = {}
    for o, _, p, *_ in lines:
        orders.setdefault(o, set()).add(p)
    pairs = Counter()
    for ps in orders.values():
        pairs.update({(cats[a], cats[b]) for a in ps for b in ps if a < b})
    got = baskets.market_basket(fact(*lines), dim, 0.1, 0.0).collect()
    want = {k: n for k, n in pairs.items() if n / len(orders) >= 0.1}
    assert {(r.category1, r.category2): r.pair_count for r in got} == want
    assert all(0 <= r.confidence_1_2 <= 1 for r in got)
    merged = baskets.market_basket(fact(*lines), dim, 0.1, 0.0, oriented=False).collect()
    both = Counter()
    for ps in orders.values():
        both.update(itertools.combinations(sorted({cats[p] for p in ps}), 2))
    assert {(r.category1, r.category2): r.pair_count for r in merged} == {
        k: n for k, n in both.items() if n / len(orders) >= 0.1
    }


def test_association_rules_match_brute_force(spark):
    rng = random.Random(2)
    sets = [{rng.choice("abcde") for _ in range(rng.randint(1, 4))} for _ in range(80)] + [{f"rare{i}"} for i in range(20)]
    lines = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "order_id int, item string")
    n = len(sets)

    def support(items):
        return sum(items <= s for s in sets) / n

    want = {}
    for k in (2, 3, 4):
        for items in itertools.combinations("abcde", k):
            whole = support(set(items))
            if whole < 0.05:
                continue
            for c in items:
                ante = set(items) - {c}
                conf = whole / support(ante)
                if conf >= 0.3:
                    want[tuple(sorted(ante)), c] = (whole, conf, conf / support({c}))
    got = {
        (tuple(r.antecedent), r.consequent[0]): (r.support, r.confidence, r.lift)
        for r in baskets.association_rules(lines, "item", 0.05, 0.3).collect()
    }
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        baskets.association_rules(lines, "item", 0.99)


def test_recommend_for_customer(fact):
    df = fact(
        ("a", 1, 1, "2024-01-01", 1), ("b", 2, 1, "2024-01-01", 1), ("b", 2, 2, "2024-01-01", 1),
        ("c", 3, 1, "2024-01-01", 1), ("c", 3, 2, "2024-01-01", 1), ("c", 3, 3, "2024-01-01", 1), ("d", 4, 9, "2024-01-01", 1),
    )
    got = baskets.recommend_for_customer(df, 1, 2).collect()
    assert [(r.product_id, r.score) for r in got] == [(2, 2), (3, 1)]


# ---- sales --------------------------------------------------------------

def test_forecast_needs_thirty_days(fact):
    short = fact(*[(f"o{i}", 1, 1, f"2024-01-{i:02d}", 10) for i in range(1, 21)])
    got = sales.sales_forecast(short, "2024-02-01", 5).collect()
    assert len(got) == 5 and all(r.forecasted_revenue is None for r in got)
    flat = fact(*[(f"o{i}", 1, 1, f"2024-01-{i:02d}", 10) for i in range(1, 31)])
    got = sales.sales_forecast(flat, "2024-02-01", 3).orderBy("date").collect()
    assert [r.date for r in got] == [dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 2)]
    assert [r.forecasted_revenue for r in got] == pytest.approx([10.0] * 3)


def test_bounds_are_ordered(rows):
    daily = rows("date date, revenue double", *[(f"2024-01-{i:02d}", float(i * 10 + (i % 3))) for i in range(1, 15)])
    got = sales.forecast_with_bounds(daily, 7).collect()
    assert len(got) == 7 and all(r.lower_bound <= r.forecast <= r.upper_bound for r in got)
    single = sales.forecast_with_bounds(daily.limit(1), 2).collect()
    assert [r.forecast for r in single] == [11.0, 11.0]
    assert sales.forecast_with_bounds(daily.limit(0), 2).count() == 0


def test_anomalies(rows):
    values = [100.0 + i % 3 for i in range(30)] + [1000.0]
    daily = rows("date date, revenue double", *[(f"2024-01-{i + 1:02d}", v) for i, v in enumerate(values)])
    for method in ("zscore", "iqr"):
        flagged = sales.sales_anomalies(daily, method).where("is_anomaly").collect()
        assert [r.revenue for r in flagged] == [1000.0]
    with pytest.raises(ValueError):
        sales.sales_anomalies(daily, "forest")


def test_summary_rejects_bad_arguments(fact):
    df = fact(("a", 1, 1, "2024-01-01", 1))
    with pytest.raises(ValueError):
        sales.sales_summary_v2(df, "hourly")
    with pytest.raises(ValueError):
        sales.daily_sales(df, "2024-02-01", "2024-01-01")


# ---- warehouse ----------------------------------------------------------

@pytest.fixture
def order_sides(rows):
    orders = rows(
        "order_id int, customer_id int, order_status string, order_purchase_timestamp timestamp",
        (1, 1, "delivered", "2024-01-01"), (2, 1, "shipped", "2024-01-02"),
    )
    items = rows("order_id int, product_id int, seller_id int, price decimal(12,2), freight_value decimal(12,2)",
                 *[(1, p, 1, __import__("decimal").Decimal("10.00"), __import__("decimal").Decimal("1.00")) for p in (1, 1, 2)])
    payments = rows("order_id int, payment_type string, payment_installments int", (1, "boleto", 1), (1, "voucher", 3))
    reviews = rows("order_id int, review_score int", (1, 5), (1, 2))
    return orders, items, payments, reviews


def test_order_summary_fan_out(order_sides):
    orders, items, payments, reviews = order_sides
    wide = by(warehouse.order_summary(orders, items, payments, reviews), "order_id")
    assert (wide[1].total_items, wide[1].total_amount, wide[1].total_freight) == (2, 120.0, 12.0)
    assert (wide[1].payment_type, wide[1].payment_installments, wide[1].review_score) == ("voucher", 3, 5)
    assert wide[2].total_items == 0 and wide[2].total_amount is None
    true = by(warehouse.order_summary(orders, items, payments, reviews, fan_out=False), "order_id")
    assert (true[1].total_amount, true[1].total_freight) == (30.0, 3.0)


def test_review_fan_out_in_performance(order_sides, rows):
    orders, items, _, reviews = order_sides
    dim = rows("product_id int, product_category_name string", (1, "A"), (2, "B"))
    sellers = rows("seller_id int, seller_city string, seller_state string", (1, "x", "y"))
    wide = by(products.product_performance(orders, items, dim, reviews), "product_category_name")
    assert wide["A"].total_revenue == 40.0 and wide["A"].avg_rating == 3.5 and wide["A"].total_orders == 1
    true = by(products.product_performance(orders, items, dim, reviews, fan_out=False), "product_category_name")
    assert true["A"].total_revenue == 20.0 and true["A"].avg_rating == 3.5
    seller = products.seller_analytics(orders, items, dim, sellers, reviews).first()
    assert (seller.total_revenue, seller.unique_categories, seller.total_orders) == (60.0, 2, 1)


def test_scd2_versions(rows):
    first = warehouse.scd2_open(rows("id int, a string, b string", (1, "x", None), (2, "y", "q"), (3, "z", "q")), "2024-01-01")
    snapshot = rows("id int, a string, b string", (1, "x", None), (2, "Y", "q"), (4, "n", None))
    merged = warehouse.scd2_merge(first, snapshot, "id", ["a", "b"], "2024-02-01")
    got = sorted((r.id, r.a, r.is_current, str(r.valid_from)[:10], str(r.valid_to)[:10]) for r in merged.collect())
    assert got == [
        (1, "x", True, "2024-01-01", "9999-12-31"),
        (2, "Y", True, "2024-02-01", "9999-12-31"),
        (2, "y", False, "2024-01-01", "2024-02-01"),
        (3, "z", True, "2024-01-01", "9999-12-31"),
        (4, "n", True, "2024-02-01", "9999-12-31"),
    ]
    again = warehouse.scd2_merge(merged, snapshot, "id", ["a", "b"], "2024-03-01")
    assert again.count() == 5


def test_date_dimension_and_holidays(rows):
    df = rows("ts timestamp", ("2024-01-06 10:00:00",), ("2024-01-06 12:00:00",), ("2024-01-08",), (None,))
    got = by(warehouse.date_dimension(df, "ts", rows("date_id date", ("2024-01-08",))), "date_id")
    saturday, monday = got[dt.date(2024, 1, 6)], got[dt.date(2024, 1, 8)]
    assert len(got) == 2
    assert (saturday.day_of_week, saturday.is_weekend, saturday.is_holiday, saturday.day_name) == (5, True, False, "Saturday")
    assert (monday.day_of_week, monday.is_weekend, monday.is_holiday, monday.month_name) == (0, False, True, "January")


def test_customer_dimension_defaults(rows):
    df = rows("customer_city string, customer_state string", ("Sao Paulo", "SP"), ("Other", "XX"))
    got = [(r.customer_city_size, r.customer_region) for r in warehouse.customer_dimension(df).collect()]
    assert sorted(got) == [("Large", "Southeast"), ("Medium", "Other")]


def test_quality_rules(rows):
    df = rows("id int, x int", (1, 5), (1, None), (2, 50), (None, 7))
    got = {r.rule: (r.checked, r.violations) for r in quality.check_rules(df, "t", {
        "id present": F.col("id").isNotNull(), "x in 1..10": F.col("x").between(1, 10)}).collect()}
    assert got == {"id present": (4, 1), "x in 1..10": (4, 2)}
    assert quality.duplicate_rule(df, "t", ["id"]).first().violations == 1
    parents = rows("id int", (1,))
    assert quality.foreign_key_rule(df, "t", "id", parents).first().violations == 1
    assert [r.id for r in quality.referential_violations(df, "id", parents).collect()] == [2]


def test_documents_of_a_huge_order_span_pages(spark, order_sides, rows):
    orders, _, payments, reviews = order_sides
    items = spark.range(12_000).select(F.lit(1).alias("order_id"), (F.col("id") + 1).cast("int").alias("order_item_id"), F.col("id").alias("product_id"))
    people = rows("customer_id int, customer_city string", (1, "x"))
    payments = payments.withColumn("payment_sequential", F.lit(1))
    reviews = reviews.withColumn("review_id", F.lit("r"))
    docs = warehouse.denormalize_order(orders, items, payments, reviews, people, page_lines=50).collect()
    first = [d for d in docs if d.order_id == 1]
    assert sorted(i.product_id for d in first for i in d["items"]) == list(range(12_000))
    assert len(first) == 240 and all([i.order_item_id for i in d["items"]] == list(range(50 * d.page + 1, 50 * d.page + 51)) for d in first)
    second = [d for d in docs if d.order_id == 2]
    assert len(second) == 1 and second[0]["items"] is None and second[0].customer.customer_city == "x"


# ---- logs ---------------------------------------------------------------

LOG = "timestamp timestamp, level string, message string, error_type string, status_code int, response_time double"


def test_error_patterns(rows):
    df = rows(
        LOG,
        ("2024-01-01 00:00:00", "ERROR", "Connection timeout", "ConnectionError", 500, 1.0),
        ("2024-01-01 00:01:00", "ERROR", "Connection timeout", "ConnectionError", 500, 1.0),
        ("2024-01-01 00:02:00", "error", "Invalid input", "ValidationError", 500, 1.0),
        ("2024-01-01 00:03:00", "INFO", "An Exception was seen", "Odd", 200, 1.0),
        ("2024-01-01 00:04:00", None, None, "Quiet", 200, 1.0),
        ("2024-01-01 00:05:00", "ERROR", "no type", None, 500, 1.0),
    )
    got = by(logs.error_patterns(df, "2024-01-01", "2024-01-02"), "error_type")
    assert {k: (r["count"], r.messages) for k, r in got.items()} == {
        "ConnectionError": (2, ["Connection timeout"]),
        "ValidationError": (1, ["Invalid input"]),
        "Odd": (1, ["An Exception was seen"]),
    }
    with pytest.raises(ValueError, match="Invalid date range"):
        logs.error_patterns(df, "2024-01-02", "2024-01-01")


def test_system_health_and_bad_numbers(rows):
    schema = LOG.replace("response_time double", "response_time string")
    df = rows(
        schema,
        ("2024-01-01", "ERROR", "x", "e", 500, "100"),
        ("2024-01-01", "INFO", "x", "e", 200, "150"),
        ("2024-01-01", "INFO", "x", "e", 200, "200"),
        ("2024-01-01", "INFO", "x", "e", 200, "slow"),
    )
    got = logs.system_health(df).first()
    assert (got.error_rate, got.success_rate, got.total_requests) == (0.25, 0.75, 4)
    assert got.avg_response_time == 150.0 and got.p95_response_time == pytest.approx(195.0)


def test_empty_hours_are_kept(rows):
    df = rows(
        "timestamp timestamp, user_id int, session_id string, event_type string, response_time double, memory_usage double, cpu_usage double",
        ("2024-01-01 00:10:00", 1, "s1", "view", 100.0, 512.0, 45.0),
        ("2024-01-01 00:20:00", 1, "s2", "click", 150.0, 600.0, 55.0),
        ("2024-01-01 03:00:00", 2, "s2", "view", 9.0, 1.0, 1.0),
    )
    speed = logs.performance_metrics_hourly(df).collect()
    assert [(r.hour.hour, r.response_time_mean, r.response_time_count) for r in speed] == [
        (0, 125.0, 2), (1, None, 0), (2, None, 0), (3, 9.0, 1)
    ]
    active = logs.user_activity_hourly(df).collect()
    assert [(r.unique_users, r.total_events, r.unique_sessions) for r in active] == [(1, 2, 2), (0, 0, 0), (0, 0, 0), (1, 1, 1)]
    whole = logs.user_activity_hourly(df, "2024-01-01", "2024-01-02").collect()
    assert len(whole) == 24


def test_trends_keep_days_without_logs(rows):
    df = rows(LOG, ("2024-01-01 13:00:00", "INFO", "x", "e", 200, 1.0), ("2024-01-03 11:00:00", "INFO", "x", "e", 500, 3.0))
    got = logs.health_trends(df, "2024-01-03 12:00:00", 3).collect()
    assert [(str(r.date), r.total_requests) for r in got] == [("2023-12-31", 0), ("2024-01-01", 1), ("2024-01-02", 1)]
    assert got[2].error_rate == 1.0
    report = logs.trend_report(logs.health_trends(df, "2024-01-03 12:00:00", 3)).first()
    assert report.request_volume_trend == [0, 1, 1]


def test_alert_needs_three_windows_in_a_row(rows):
    schema = "timestamp timestamp, service string, status_code int, response_time double"
    one = rows(schema, ("2024-01-01 00:10:30", "a", 500, 0.1), ("2024-01-01 00:10:40", "a", 200, 0.1))
    got = logs.rate_alerts(one).orderBy("window_start").collect()
    # five windows hold the minute; a breach counts from the third one on
    assert [str(r.window_start)[11:16] for r in got] == ["00:08", "00:09", "00:10"]
    assert all(r.high_error_rate and not r.high_latency for r in got)


def test_limits(rows):
    df = rows("timestamp timestamp, user_id int, ip_address string",
              *[(f"2024-01-01 00:{m:02d}:00", 1, "a") for m in range(5)], *[(f"2024-01-01 01:{m:02d}:00", 1, "b") for m in range(4)])
    alerts = logs.failed_login_alert(df).collect()
    assert [(r.ip_address, r.requests) for r in alerts] == [("a", 5)]
    assert logs.fixed_window_rate(df, "user_id", limit=4).count() == 1
    assert logs.fixed_window_rate(df, "user_id", limit=5).count() == 0


def test_scan_and_retention(rows):
    df = rows(LOG, *[(f"2024-01-{d:02d}", "ERROR", "m", "e", 500, 1.0) for d in (3, 1, 2)])
    assert [r.timestamp.day for r in logs.scan_logs(df, "2024-01-01", "2024-01-03").collect()] == [1, 2]
    assert [r.timestamp.day for r in logs.scan_logs(df, "2024-01-01", "2024-01-09", size=1).collect()] == [1]
    assert logs.apply_retention(df, "2024-02-01", kind="indexed_logs").count() == 2
    assert logs.apply_retention(df, "2024-02-01", days=29).count() == 1
    assert logs.find_logs(df, {"level": "ERROR"}, "2024-01-02").count() == 2


def test_missing_columns_raise(rows):
    wrong = rows("wrong_column int", (1,))
    with pytest.raises(ValueError, match="missing columns"):
        customers.customer_ltv(wrong, wrong, "2024-01-01")
    with pytest.raises(ValueError):
        customers.customer_segmentation(wrong, "2024-01-01")
    with pytest.raises(ValueError):
        baskets.product_recommendations(wrong, wrong, 1)
    with pytest.raises(ValueError):
        baskets.market_basket(wrong, wrong)
    with pytest.raises(ValueError):
        sales.sales_forecast(wrong, "2024-01-01")


def test_days_from_hourly_sketches(spark):
    """Within the stated errors over ranges of hours, and exact where there are few values; hours merge in any order."""
    from tallymart.operators import logs

    raw = spark.range(0, 120_000, 1, 8).select(
        (F.timestamp_seconds(1_704_067_200 + F.col("id") * 13 % 864_000)).alias("timestamp"), (F.xxhash64("id") % 40_000).alias("user_id"),
        F.when(F.col("id") % 50 == 0, 500).otherwise(200).alias("status_code"), F.when(F.col("id") % 9 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) / 7).alias("response_time"),
    )
    hours = logs.hourly_sketches(raw)
    for by in ("day", "week"):
        got = {r[by]: r for r in logs.health_from_hours(hours.repartition(5), by).collect()}
        exact = raw.groupBy(F.date_trunc(by, "timestamp").alias(by)).agg(
            F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count("response_time").alias("timed"), F.sort_array(F.collect_list("response_time")).alias("times")).collect()
        assert len(got) == len(exact) > 1
        for e in exact:
            r = got[e[by]]
            assert r.requests == e.n and abs(r.unique_users - e.users) <= 3 * 1.04 / 2**7 * e.users
            for p, v in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
                rank = sum(t <= v for t in e.times) / e.timed
                assert abs(rank - p) < 0.004
    few = raw.where("user_id = 7")
    got = logs.health_from_hours(logs.hourly_sketches(few.withColumn("response_time", F.lit(None).cast("double")))).collect()
    assert sum(r.unique_users for r in got) == len(got) and all(r.p50 is None for r in got)
    assert logs.health_from_hours(logs.hourly_sketches(raw.limit(0))).collect() == []


def test_late_observations_split_versions_and_facts_meet_theirs(spark, rows):
    import random

    from tallymart.operators import warehouse

    rng = random.Random(6)
    seen = [(k, rng.choice("ab") if rng.random() < 0.8 else None, f"2024-{m:02d}-{d:02d} 0{d % 9}:00:00") for k in range(6) for m in range(1, 13) for d in (3, 17) if rng.random() < 0.4]
    schema = "id int, a string, observed_at timestamp"
    make = lambda data: rows(schema, *data)
    want = sorted(map(tuple, warehouse.scd2_history(make(seen), "id", ["a"]).collect()), key=str)
    brute = []
    for k in range(6):
        mine, versions = sorted((at, a) for i, a, at in seen if i == k), []
        for at, a in mine:
            if not versions or versions[-1][1] != a:
                versions.append((at, a))
        brute += [(k, a, at) for at, a in versions]
    assert sorted(str((r[0], r[1], str(r[2]))) for r in want) == sorted(map(str, brute))
    order = seen[:]
    rng.shuffle(order)
    parts = [order[: len(order) // 2], order[len(order) // 2 : -3], order[-3:]]
    history, known = warehouse.scd2_history(make(parts[0]), "id", ["a"]), make(parts[0])
    for part in parts[1:]:
        known = known.unionByName(make(part))
        history = warehouse.scd2_late(history, known, make(part), "id", ["a"])
    assert sorted(map(tuple, history.collect()), key=str) == want
    facts = [(i, rng.randrange(7), f"2024-{rng.randint(1, 12):02d}-{rng.choice([3, 10, 17]):02d} 0{rng.randrange(9)}:00:00") for i in range(300)] + [(900, None, "2024-05-05 00:00:00"), (901, 1, None)]
    df = rows("n int, id int, ts timestamp", *facts)
    got = {r.n: r.a for r in warehouse.at_its_time(df, history, "id", "ts", ["a"], "month").collect()}
    for n, k, ts in facts:
        before = [a for at, a in sorted((at, a) for i, a, at in seen if i == k and ts is not None and at <= ts)]
        assert got[n] == (before[-1] if before else None), (n, k, ts)
    assert len(got) == len(facts)


def plain_holt_winters(y, m, a, b, g):
    level, later = sum(y[:m]) / m, sum(y[m : 2 * m]) / m
    trend, s, sse = (later - level) / m, [v - level for v in y[:m]], 0.0
    for t in range(m, len(y)):
        error = y[t] - (level + trend + s[t % m])
        up = a * (y[t] - s[t % m]) + (1 - a) * (level + trend)
        trend = b * (up - level) + (1 - b) * trend
        s[t % m] = g * (y[t] - up) + (1 - g) * s[t % m]
        level = up
        sse += error * error if t >= 2 * m else 0.0
    return sse, level, trend, s


def test_seasonal_forecasts_equal_a_plain_version(spark, rows):
    import math
    import random

    from tallymart.operators import sales

    rng = random.Random(9)
    data, want = [], {}
    for key, n in (("a", 40), ("b", 23), ("short", 8), ("c", 30)):
        y = [round(50 + 2 * t + 20 * math.sin(t * math.pi / 2) + rng.uniform(-5, 5), 3) if key != "c" or t % 7 else 0.0 for t in range(n)]
        y[0], y[-1] = 30.0, 40.0
        data += [(key, f"{2020 + t // 12}-{t % 12 + 1:02d}-{rng.randint(1, 28):02d} 05:00:00", v / 2) for t, v in enumerate(y) if v for _ in range(2)]
        if n > 8:
            best = min((plain_holt_winters(y, 4, *w) for w in sales.WEIGHTS), key=lambda r: r[0])
            sse, level, trend, s = best
            for h in range(1, 4):
                middle, width = level + h * trend + s[(n + h - 1) % 4], 1.96 * math.sqrt(sse / (n - 8) * h)
                t = n + h - 1
                want[key, f"{2020 + t // 12}-{t % 12 + 1:02d}-01"] = (middle, middle - width, middle + width)
    df = rows("k string, at timestamp, v double", *data, (None, "2020-01-01", 1.0), ("a", None, 5.0))
    out = sales.seasonal_forecasts(df, "k", "at", "v", season=4, periods=3)
    got = {(r.k, str(r.date)[:10]): (r.forecast, r.lower, r.upper) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) and got[k][1] <= got[k][0] <= got[k][2] for k in want)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert sales.seasonal_forecasts(df.limit(0), "k", "at", "v").collect() == []
