import json

import pytest
from pyspark.sql import functions as F

from tallymart import schemas
from tallymart.sources import landing, readers, store, writers
from tallymart.streaming import jobs


def feed(folder, topic, name, *messages):
    path = folder / topic
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages))


def run(spark, tmp_path, topic, job, name="out"):
    messages = readers.read_json_stream(spark, topic, schemas.MESSAGES[topic], "text", path=str(tmp_path))
    query = writers.lake_stream_sink(job(messages), str(tmp_path / "lake"), name, available_now=True)
    query.awaitTermination()
    frame = spark.read.parquet(str(tmp_path / "lake" / name))
    return query, sorted(frame.collect(), key=lambda r: r.window.start)


def customer(ts):
    return {"customer_id": ts, "timestamp": ts}


def test_malformed_messages_go_to_the_rejects(spark, tmp_path):
    feed(tmp_path, "customers", "1.json", customer("2024-01-01T00:00:00"), "{not json", "[]")
    raw = spark.read.text(str(tmp_path / "customers"))
    parsed = readers.parse_json(raw, schemas.CUSTOMER_MESSAGE)
    assert readers.good_rows(parsed).where("customer_id is not null").count() == 1
    assert "{not json" in [r[0] for r in readers.rejected_rows(parsed).collect()]


def test_customers_per_hour(spark, tmp_path):
    feed(
        tmp_path, "customers", "1.json",
        customer("2024-01-01T00:10:00"), customer("2024-01-01T00:50:00"), customer("2024-01-01T02:00:00"),
        customer("not a time"), "{broken", customer("2024-01-01T09:00:00"),
    )
    _, got = run(spark, tmp_path, "customers", jobs.new_customers)
    assert [(r.window.start.hour, r["count"]) for r in got] == [(0, 2), (2, 1)]


def test_exact_customers_and_calendar_delay(spark, tmp_path):
    def order(i, who, ts, delivered=None):
        return {
            "order_id": str(i), "customer_id": who, "order_purchase_timestamp": ts,
            "order_delivered_customer_date": delivered, "order_estimated_delivery_date": "2024-01-05T23:00:00",
        }

    feed(
        tmp_path, "orders", "1.json",
        order(1, "a", "2024-01-01T00:10:00", "2024-01-06T01:00:00"), order(2, "a", "2024-01-01T00:20:00"),
        order(3, "b", "2024-01-01T00:30:00", "2024-01-04T23:30:00"), order(4, "c", "2024-01-01T09:00:00"),
    )
    _, got = run(spark, tmp_path, "orders", jobs.order_stats)
    assert [(r.total_orders, r.unique_customers, r.avg_delivery_delay) for r in got] == [(3, 2, 0.0)]


def test_items_null_and_empty(spark, tmp_path):
    def envelope(ts, items):
        return {"order_id": "1", "timestamp": ts, "items": items}

    item = {"order_id": "1", "order_item_id": 1, "product_id": "p", "price": 100.0, "freight_value": 10.0}
    feed(
        tmp_path, "order_items", "1.json",
        envelope("2024-01-01T00:10:00", [item, {**item, "price": 50.0}]), envelope("2024-01-01T00:11:00", None),
        envelope("2024-01-01T00:12:00", []), envelope("2024-01-01T09:00:00", [item]),
    )
    _, got = run(spark, tmp_path, "order_items", jobs.sales_stats)
    assert [(r.total_sales, r.avg_price, r.total_freight, r.total_items) for r in got] == [(150.0, 75.0, 20.0, 2)]


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    feed(tmp_path, "customers", "1.json", customer("2024-01-01T00:10:00"), customer("2024-01-01T06:00:00"))
    _, got = run(spark, tmp_path, "customers", jobs.new_customers)
    assert [(r.window.start.hour, r["count"]) for r in got] == [(0, 1)]
    # The run above closed the first hour; a late row for it changes nothing.
    feed(tmp_path, "customers", "2.json", customer("2024-01-01T00:20:00"), customer("2024-01-01T12:00:00"))
    query, got = run(spark, tmp_path, "customers", jobs.new_customers)
    assert [(r.window.start.hour, r["count"]) for r in got] == [(0, 1), (6, 1)]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])
    assert dropped == 1


def test_batch_and_stream_agree(spark, tmp_path):
    times = [f"2024-01-01T{h:02d}:{m:02d}:00" for h in range(8) for m in (1, 30)]
    feed(tmp_path, "customers", "1.json", *[customer(t) for t in times])
    _, got = run(spark, tmp_path, "customers", jobs.new_customers)
    raw = spark.read.text(str(tmp_path / "customers"))
    batch = jobs.new_customers(readers.good_rows(readers.parse_json(raw, schemas.CUSTOMER_MESSAGE)))
    whole = {r.window.start: r["count"] for r in batch.collect()}
    assert len(got) == 6 and all(whole[r.window.start] == r["count"] for r in got)


def test_all_jobs_and_landing(spark, tmp_path):
    for topic in schemas.TOPICS:
        feed(tmp_path, topic, "1.json", {"order_id": "1", "timestamp": "2024-01-01T00:00:00"})
    lake = str(tmp_path / "lake")
    queries = jobs.start_landing(spark, lake, "text", available_now=True, path=str(tmp_path))
    queries += jobs.start_jobs(spark, lake, "text", available_now=True, path=str(tmp_path))
    jobs.run_until_failure(spark, queries)
    for topic in schemas.TOPICS:
        assert spark.read.parquet(f"{lake}/raw/{topic}").count() == 1


def test_jobs_and_landing_run_at_the_same_time(spark, tmp_path):
    for topic in schemas.TOPICS:
        feed(tmp_path, topic, "1.json", {"order_id": "1", "timestamp": "2024-01-01T00:00:00"})
    lake = str(tmp_path / "lake")
    queries = jobs.start_landing(spark, lake, "text", path=str(tmp_path)) + jobs.start_jobs(spark, lake, "text", path=str(tmp_path))
    try:
        assert len({q.name for q in queries}) == 8 and all(q.isActive for q in queries)
    finally:
        for q in queries:
            q.stop()


def test_a_failing_job_stops_the_others(spark, tmp_path):
    for topic in ("customers", "orders"):
        feed(tmp_path, topic, "1.json", customer("2024-01-01T00:00:00"))
    good = readers.read_json_stream(spark, "customers", schemas.CUSTOMER_MESSAGE, "text", path=str(tmp_path))
    bad = readers.read_json_stream(spark, "orders", schemas.ORDER_MESSAGE, "text", path=str(tmp_path))
    bad = bad.withColumn("x", F.raise_error(F.lit("broken job")))
    queries = [
        writers.lake_stream_sink(good, str(tmp_path / "lake"), "good", trigger="1 second"),
        writers.lake_stream_sink(bad, str(tmp_path / "lake"), "bad", trigger="1 second"),
    ]
    with pytest.raises(Exception, match="broken job"):
        jobs.run_until_failure(spark, queries)
    assert not any(q.isActive for q in queries)


def test_publish_round_trip(spark, tmp_path):
    df = spark.range(3).select(F.col("id").cast("string").alias("customer_id"))
    writers.publish_json(df, "customers", "text", str(tmp_path))
    raw = spark.read.text(str(tmp_path / "customers"))
    back = readers.good_rows(readers.parse_json(raw, schemas.CUSTOMER_MESSAGE))
    assert sorted(r.customer_id for r in back.collect()) == ["0", "1", "2"]


# ---- landing by day, supervision, alerts that hold -----------------------

def day_rows(rows, *data):
    return landing.by_date(rows("id int, at timestamp", *data), F.to_date("at"))


def test_a_batch_is_landed_once(spark, rows, tmp_path):
    root = str(tmp_path / "lake/clicks")
    one, two = day_rows(rows, (1, "2024-01-01 10:00:00"), (2, None)), day_rows(rows, (3, "2024-01-02 10:00:00"))
    assert landing.land_batch(one, 0, root, "q") and not landing.land_batch(one, 0, root, "q")
    assert landing.land_batch(two, 1, root, "q") and not landing.land_batch(one, 0, root, "q") and landing.land_batch(two, 0, root, "another")
    assert sorted(r.id for r in landing.read_landed(spark, str(tmp_path / "lake"), "clicks").collect()) == [1, 2, 3, 3]


def test_a_range_reads_its_days_only_and_small_files_go(spark, rows, tmp_path):
    lake, root = str(tmp_path / "lake"), str(tmp_path / "lake/clicks")
    for i in range(6):
        landing.land_batch(day_rows(rows, *[(10 * i + d, f"2024-01-0{d} 10:00:00") for d in (1, 2, 3)]), i, root, "q", compact_after=2)
    chunks = store.Store(spark, root).manifest()["tables"][landing.ROWS]["chunks"]
    assert set(chunks) == {"2024-01-01", "2024-01-02", "2024-01-03"} and all(len(w) <= 3 for w in chunks.values())
    got = landing.read_landed(spark, lake, "clicks", "2024-01-02", "2024-01-03")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert sorted(r.id for r in got.collect()) == [2 + 10 * i for i in range(6)]
    assert all("event_date=2024-01-02" in f for f in got.select("id").where("event_date = '2024-01-02'").inputFiles()) or len(got.inputFiles()) > 1
    with pytest.raises(ValueError):
        landing.by_date(rows("at timestamp"), F.to_date("at"), "year")


def test_a_landed_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    lake = str(tmp_path / "lake")
    for file, hours in (("1.json", (0, 1, 6)), ("2.json", (30,)), ("3.json", (54,))):
        feed(tmp_path, "customers", file, *[customer(f"2024-01-0{1 + h // 24}T{h % 24:02d}:10:00") for h in hours])
        messages = readers.read_json_stream(spark, "customers", schemas.CUSTOMER_MESSAGE, "text", path=str(tmp_path))
        landing.land_stream(jobs.new_customers(messages), lake, "customers", available_now=True).awaitTermination()
    got = landing.read_landed(spark, lake, "customers").collect()
    assert sorted((str(r.event_date), r.window.start.hour, r["count"]) for r in got) == [
        ("2024-01-01", 0, 1), ("2024-01-01", 1, 1), ("2024-01-01", 6, 1), ("2024-01-02", 6, 1)]


def test_a_query_that_fails_once_is_started_again(spark, tmp_path):
    for topic in ("customers", "reviews"):
        feed(tmp_path, topic, "1.json", customer("2024-01-01T00:10:00"), customer("2024-01-01T09:00:00"))
    lake, failures = str(tmp_path / "lake"), {"customers": 1}
    watcher = jobs.Watcher()
    spark.streams.addListener(watcher)

    def start(topic):
        def begin():
            messages = readers.read_json_stream(spark, topic, schemas.CUSTOMER_MESSAGE, "text", path=str(tmp_path))
            if failures.get(topic, 0):
                failures[topic] -= 1
                messages = messages.withColumn("customer_id", F.raise_error(F.lit("broken once")).cast("string"))
            return landing.land_stream(messages, lake, topic, available_now=True, day=F.to_date("timestamp"))

        return begin

    try:
        assert jobs.supervise(spark, {t: start(t) for t in ("customers", "reviews")}, tries=2) == {"customers": 1}
        for topic in ("customers", "reviews"):
            assert landing.read_landed(spark, lake, topic).count() == 2
        failures["customers"] = 9
        feed(tmp_path, "customers", "2.json", customer("2024-01-02T00:10:00"))
        feed(tmp_path, "reviews", "2.json", customer("2024-01-02T00:10:00"))
        with pytest.raises(RuntimeError, match="gave up on customers after 3 tries"):
            jobs.supervise(spark, {t: start(t) for t in ("customers", "reviews")}, tries=3)
        assert landing.read_landed(spark, lake, "customers").count() == 2 and landing.read_landed(spark, lake, "reviews").count() == 3
    finally:
        spark.streams.removeListener(watcher)
    starts = {n.rpartition("_")[2]: f["starts"] for n, f in watcher.figures.items()}
    assert starts["customers"] == 5 and starts["reviews"] == 2
    assert sum(len(f["errors"]) for f in watcher.figures.values()) == 4


def test_alerts_hold_over_batches_and_late_rows(spark, tmp_path):
    from tallymart.operators import logs

    def log(minute, status, service="a", latency=1.0):
        return {"timestamp": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:30", "service": service, "status_code": status, "response_time": latency}

    batches = [
        [log(m, 500 if m in (10, 11) else 200) for m in range(0, 12)] + [log(m, 200, "b", 9.0 if m > 3 else 0.125) for m in range(0, 12)],
        [log(m, 500 if m < 14 else 200) for m in range(12, 60)] + [log(5, 500)],  # a late row that is still in time
        [log(m, 200, latency=5.0) for m in range(200, 204)],
        [log(600, 200)],
    ]
    schema = "timestamp timestamp, service string, status_code int, response_time double"
    for i, batch in enumerate(batches):
        feed(tmp_path, "logs", f"{i}.json", *batch)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "logs"))
        writers.lake_stream_sink(jobs.held_alerts(stream), str(tmp_path / "lake"), "alerts", available_now=True).awaitTermination()
    key = lambda r: (r.service, r.window_start, r.requests, r.error_rate, r.avg_latency, r.high_error_rate, r.high_latency)
    got = spark.read.parquet(str(tmp_path / "lake/alerts")).select("*", "window.start").withColumnRenamed("start", "window_start")
    want = [key(r) for r in logs.rate_alerts(spark.read.schema(schema).json(str(tmp_path / "logs"))).collect() if r.window_end.hour < 9]
    assert sorted(map(key, got.collect())) == sorted(want) and len(want) > 10


def test_all_topics_of_more_sign_ups_than_their_microseconds_fit_a_long(spark, tmp_path):
    """Sums of epoch microseconds of 6,000 rows are beyond 2**63; the figures equal the SQL's."""
    from compare import differences, spark_result, sql_result

    from tallymart.catalog import QUERIES, SQL
    from tallymart.schemas import GIVEN_TABLES
    from tallymart.staging import Tables

    import duckdb

    hours = lambda start, step: F.expr(f"TIMESTAMP '{start}' + id * INTERVAL {step} MINUTE")
    rows = {
        "events": spark.range(6000).select(
            F.col("id").alias("event_id"), hours("2024-01-01", 7).alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("signup").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")),
        "orders": spark.range(40).select(
            F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), (F.col("id") + 0.5).alias("o_totalprice"), hours("1998-01-01", 50).alias("o_orderdate"), F.lit("1").alias("o_orderpriority")),
        "lineitem": spark.range(40).select(
            F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), (F.col("id") + 0.25).alias("l_extendedprice"),
            F.lit(0.0).alias("l_discount"), F.lit(0.02).alias("l_tax"), F.lit("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), hours("1998-02-01", 50).alias("l_shipdate")),
    }
    con = duckdb.connect()
    for name, df in rows.items():
        df.select([F.col(f.name).cast(f.dataType) for f in GIVEN_TABLES[name].fields]).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("region", "nation", "customer", "supplier", "part"):
        cells = ", ".join(f"NULL AS {f.name}" for f in GIVEN_TABLES[name].fields)
        con.execute(f"CREATE VIEW {name} AS SELECT {cells} WHERE false")
    got = spark_result(QUERIES["stream_all_topics"](Tables(spark, str(tmp_path))))
    assert differences(got, sql_result(con, SQL["stream_all_topics"])) is None
