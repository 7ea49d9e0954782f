import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallymart import schemas
from tallymart.plans import load, marts
from tallymart.session import scratch_dir
from tallymart.sources import readers, writers


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)


@pytest.fixture
def lake(rows, tmp_path):
    """Two days of 24 hourly rows for each lake table."""

    def hours(*columns):
        df = rows("start timestamp, v int", *[(f"2024-01-0{d} {h:02d}:00:00", h) for d in (1, 2) for h in range(24)])
        window = F.struct("start", (F.col("start") + F.expr("interval 1 hour")).alias("end")).alias("window")
        return df.select(window, *columns)

    one = F.lit(1).cast("bigint")
    hours(one.alias("count")).write.parquet(str(tmp_path / "lake/customers"))
    hours(
        F.lit(10.0).alias("total_sales"), F.col("v").cast("double").alias("avg_price"),
        F.lit(1.0).alias("total_freight"), one.alias("total_items"),
    ).write.parquet(str(tmp_path / "lake/sales"))
    hours(
        F.col("v").cast("bigint").alias("total_orders"),
        F.when(F.col("v") < 2, F.col("v").cast("double")).alias("avg_delivery_delay"),
        one.alias("unique_customers"),
    ).write.parquet(str(tmp_path / "lake/orders"))
    return str(tmp_path / "lake")


def test_last_hour_is_kept(spark, lake):
    day = ("2024-01-01", "2024-01-02")
    assert readers.read_lake(spark, f"{lake}/customers", *day).count() == 24
    assert readers.read_lake(spark, f"{lake}/customers", *day, strict_end=True).count() == 23


def test_lake_filter_is_pushed_to_the_scan(spark, lake):
    df = readers.read_lake(spark, f"{lake}/sales", "2024-01-01", "2024-01-02").select("total_sales")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(window.start" in plan and "avg_price" not in plan.split("ReadSchema")[1]


def test_marts_are_idempotent_and_use_history(spark, lake, tmp_path):
    target = str(tmp_path / "marts")
    for _ in range(2):
        paths = marts.process_all_marts(spark, lake, target, dt.date(2024, 1, 3), days_ago=1)
    growth = spark.read.parquet(paths[0]).collect()
    assert [(str(r.date), r.new_customers, r.total_customers) for r in growth] == [("2024-01-02", 24, 48)]
    marts.process_all_marts(spark, lake, target, dt.date(2024, 1, 3), days_ago=2)
    assert spark.read.parquet(paths[0]).count() == 2
    sales = spark.read.parquet(paths[1]).where("date = '2024-01-02'").first()
    assert (sales.daily_revenue, sales.total_revenue, sales.revenue_7day_avg) == (240.0, 264.0, 264.0)
    with pytest.raises(ValueError):
        marts.process_all_marts(spark, lake, target, dt.date(2024, 1, 3), days_ago=0)


def test_weighted_means(spark, lake):
    orders = spark.read.parquet(f"{lake}/orders")
    plain = marts.order_performance_mart(orders).first()
    weighted = marts.order_performance_mart(orders, weighted=True).first()
    assert plain.avg_delivery_delay == 0.5 and weighted.avg_delivery_delay == 1.0
    assert plain.orders_per_customer == sum(range(24)) / 24


def test_csv_with_mark_quotes_and_types(spark, tmp_path):
    put(tmp_path / "category_translation.csv",
        'product_category_name,product_category_name_english\nbeleza,"health, beauty"\n', "utf-8-sig")
    got = readers.read_extract(spark, str(tmp_path), "category_translation").first()
    assert tuple(got) == ("beleza", "health, beauty")


def test_load_from_extracts(spark, tmp_path):
    folder = tmp_path / "raw"
    put(folder / "customers.csv",
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,01000,Sao Paulo,SP\n")
    put(folder / "orders.csv",
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
        "order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,delivered,2024-01-01 10:00:00,,,2024-01-05 09:00:00,2024-01-05 10:00:00\n"
        "o2,c1,shipped,2024-01-02 10:00:00,,,,2024-01-09 10:00:00\n")
    put(folder / "order_items.csv",
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,p1,s1,2024-01-03 00:00:00,10.50,1.25\no2,1,p2,s1,2024-01-03 00:00:00,20.00,2.00\n")
    put(folder / "products.csv",
        "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,"
        "product_weight_g,product_length_cm,product_height_cm,product_width_cm\np1,beleza,1,1,1,100,2,3,4\np2,auto,1,1,1,300,4,4,4\n")
    put(folder / "sellers.csv", "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,x,SP\n")
    put(folder / "category_translation.csv",
        "product_category_name,product_category_name_english\nbeleza,health_beauty\n", "utf-8-sig")
    for _ in range(2):
        star = load.etl_run(spark, str(folder), str(tmp_path / "star"))
    fact = {r.order_id: r for r in star.read("fact_sales").collect()}
    assert float(fact["o1"].total_amount) == 11.75 and fact["o1"].delivery_delay_days == -1 and fact["o1"].shipping_days == 3
    assert fact["o2"].delivery_delay_days is None and str(fact["o2"].order_date) == "2024-01-02"
    dim = {r.product_id: r for r in star.read("dim_product").collect()}
    assert dim["p1"].product_category_name_english == "health_beauty" and dim["p2"].product_volume_cm3 == 64
    assert star.read("dim_date").count() == 2 and star.read("dim_seller").count() == 1 and star.version() == 2


def test_date_partitions_are_pruned(spark, rows, tmp_path):
    df = rows("order_date date, x int", ("2024-01-01", 1), ("2024-01-02", 2), ("2024-02-02", 3))
    path = str(tmp_path / "fact")
    writers.partition_by_time(df, path)
    plan = spark.read.parquet(path).where("order_date = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_date" in plan
    writers.partition_by_time(df.where("x = 2").withColumn("x", F.lit(9)), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 3, 9]
    with pytest.raises(ValueError):
        writers.partition_by_time(df, path, chunk="year")


def test_last_row_of_a_key_wins(rows):
    old = rows("id int, v string, seq int", (1, "a", 0), (2, "b", 0))
    new = rows("id int, v string, seq int", (2, "x", 1), (2, "y", 2), (3, "z", 1))
    got = {r.id: r.v for r in writers.upsert_dimension(old, new, "id", "seq").collect()}
    assert got == {1: "a", 2: "y", 3: "z"}


def test_named_parameters(spark, rows):
    rows("ts timestamp, v int", ("2024-01-01", 1), ("2024-02-01", 2)).createOrReplaceTempView("some_rows")
    got = readers.read_query(spark, "SELECT v FROM some_rows WHERE ts >= :since", since=dt.datetime(2024, 1, 15))
    assert [r.v for r in got.collect()] == [2]
    assert readers.read_table(spark, "some_rows").count() == 2


def test_json_logs(spark, tmp_path):
    put(tmp_path / "access.log",
        '{"time_local":"01/Jan/2024:10:00:00 +0000","remote_addr":"1.2.3.4","remote_user":"","request":"GET /x HTTP/1.1",'
        '"status":"404","body_bytes_sent":"12","request_time":"0.250","trace_id":"t"}\n'
        '{"time_local":"bad","request":"GET","status":"-"}\n')
    good, bad = sorted(readers.read_access_log(spark, str(tmp_path / "access.log")).collect(), key=lambda r: r.timestamp is None)
    assert (good.method, good.endpoint, good.status_code, good.response_time) == ("GET", "/x", 404, 0.25)
    assert good.timestamp == dt.datetime(2024, 1, 1, 10)
    assert bad.timestamp is None and bad.endpoint is None and bad.status_code is None
    put(tmp_path / "app.log", '{"timestamp":"2024-01-01 10:00:00,125","level":"INFO","logger":"a","message":"m"}\n')
    assert readers.read_application_log(spark, str(tmp_path / "app.log")).first().timestamp == dt.datetime(2024, 1, 1, 10, 0, 0, 125000)


def test_scratch_follows_the_session():
    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    one, two = (scratch_dir(session("spark://host:7077", "/shared/runs/"), "lake") for _ in range(2))
    assert one.startswith("/shared/runs/lake-") and one != two
    with pytest.raises(ValueError):
        scratch_dir(session("spark://host:7077", None), "lake")
    kept = {}
    local = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: kept.get(key, default), set=kept.__setitem__), sparkContext=SimpleNamespace(master="local[2]"))
    roots = {scratch_dir(local, "lake").rsplit("/", 1)[0] for _ in range(2)}
    assert len(roots) == 1 and "tallymart-" in roots.pop()


def test_message_schemas():
    assert set(schemas.MESSAGES) == set(schemas.TOPICS)
    assert [f.name for f in schemas.ORDER_MESSAGE.fields][:3] == ["order_id", "customer_id", "order_status"]
    assert schemas.ITEMS_MESSAGE["items"].dataType.elementType["price"].dataType.typeName() == "double"


@pytest.mark.parametrize("chunk", ["day", "week", "month"])
def test_merging_keeps_the_other_rows_of_a_chunk(spark, rows, tmp_path, chunk):
    schema, path = "id int, order_date date, x int", str(tmp_path / "fact")
    read = lambda: sorted((r.id, str(r.order_date), r.x) for r in spark.read.parquet(path).collect())
    merge = lambda *data: writers.merge_by_time(rows(schema, *data), path, ["id"], chunk=chunk)
    merge((1, "2024-01-01", 1), (2, "2024-01-02", 2), (3, "2024-01-02", 3))
    merge((4, "2024-01-02", 4), (2, "2024-01-02", 9))
    assert read() == [(1, "2024-01-01", 1), (2, "2024-01-02", 9), (3, "2024-01-02", 3), (4, "2024-01-02", 4)]
    merge((1, "2024-03-05", 7))  # the only row of its day moves to another chunk
    assert read() == [(1, "2024-03-05", 7), (2, "2024-01-02", 9), (3, "2024-01-02", 3), (4, "2024-01-02", 4)]


def test_a_stored_table_may_be_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "view")
    for _ in range(3):
        writers.replace_table(spark.range(2) if not (tmp_path / "view").exists() else spark.read.parquet(path).union(spark.range(1)), path)
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["view"]


@pytest.mark.parametrize("chunk", ["day", "week", "month"])
def test_ranges_prune_stored_facts(spark, tmp_path, chunk):
    from tallymart.operators import customers

    path = str(tmp_path / "fact")
    fact = spark.sql("""SELECT id AS order_id, id AS customer_id, id AS product_id, id AS seller_id, 1.5BD AS price, 0.5BD AS freight_value, 2.0BD AS total_amount,
        timestamp'2024-01-01 05:00:00' + make_dt_interval(id) AS order_timestamp, date'2024-01-01' + CAST(id AS INT) AS order_date, false AS is_returned FROM range(120)""")
    writers.partition_by_time(fact, path, chunk=chunk)
    stored = spark.read.parquet(path)
    for df in (customers.customer_metrics(stored, "2024-04-30", 30), customers.customer_segmentation(stored, "2024-04-30")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan
    from tallymart.functions.dates import between_dates

    got = between_dates(stored, "order_timestamp", "2024-02-03 05:00:00", "2024-02-20 05:00:00")
    assert got.count() == 18 and "PartitionFilters: []" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", ["day", "week", "month"])
def test_merging_keeps_rows_without_a_date(spark, rows, tmp_path, chunk):
    schema, path = "id int, order_date date, x int", str(tmp_path / "fact")
    read = lambda: sorted((r.id, str(r.order_date), r.x) for r in spark.read.parquet(path).collect())
    merge = lambda *data: writers.merge_by_time(rows(schema, *data), path, ["id"], chunk=chunk)
    merge((1, None, 1), (2, None, 2), (3, "2024-01-02", 3))
    merge((9, None, 9), (1, "2024-01-02", 10))  # a key leaves the rows without a date, another one comes
    assert read() == [(1, "2024-01-02", 10), (2, "None", 2), (3, "2024-01-02", 3), (9, "None", 9)]
    merge((2, "2024-01-02", 2), (9, "2024-01-02", 9))  # none is left without a date
    assert read() == [(1, "2024-01-02", 10), (2, "2024-01-02", 2), (3, "2024-01-02", 3), (9, "2024-01-02", 9)]


def test_marts_take_earlier_days_from_what_is_kept(spark, rows, tmp_path):
    """Out-of-order days give what a full run gives, and a run reads its own days of the lake only."""
    from tallymart.sources.landing import by_date, land_batch

    def hours(days):
        df = rows("start timestamp, v int", *[(f"2024-01-{d:02d} {h:02d}:00:00", d * h) for d in days for h in (0, 7, 23)])
        window = F.struct("start", (F.col("start") + F.expr("interval 1 hour")).alias("end")).alias("window")
        v = F.col("v").cast("double")
        return {
            "customers": df.select(window, F.col("v").cast("bigint").alias("count")),
            "sales": df.select(window, (v * 1.37).alias("total_sales"), v.alias("avg_price"), (v / 3).alias("total_freight"), F.lit(1).cast("bigint").alias("total_items")),
            "orders": df.select(window, F.col("v").cast("bigint").alias("total_orders"), v.alias("avg_delivery_delay"), F.lit(2).cast("bigint").alias("unique_customers")),
        }

    lake, target = str(tmp_path / "lake"), str(tmp_path / "marts")
    steps = [  # days that come, first day after those asked for, how many are asked for
        ([1, 2, 3, 6], 7, 30), ([7], 8, 1), ([9, 10], 11, 1), ([4], 5, 1), ([12, 14, 15, 16, 17, 18, 19, 20], 21, 8), ([5, 13], 14, 9),
    ]
    come = []
    for batch, (days, as_of, days_ago) in enumerate(steps):
        for name, df in hours(days).items():
            land_batch(by_date(df, F.to_date("window.start")), batch, f"{lake}/{name}", "all")
        come += days
        marts.process_all_marts(spark, lake, target, dt.date(2024, 1, as_of), days_ago)
        # Days that have come but were not asked for are not known yet; none here.
        full = {"customer_growth_mart": marts.customer_growth_mart(hours(come)["customers"]), "sales_trends_mart": marts.sales_trends_mart(hours(come)["sales"]),
                "order_performance_mart": marts.order_performance_mart(hours(come)["orders"])}
        for name, want in full.items():
            got = spark.read.schema(want.schema).parquet(f"{target}/{name}").select(*want.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (name, days)
    read = marts.lake_hours(spark, lake, "sales", dt.date(2024, 1, 5), dt.date(2024, 1, 6))
    scanned = read.groupBy("event_date").count().collect()
    assert [str(r.event_date) for r in scanned] == ["2024-01-05"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_few_files_hold_a_value_of_a_clustered_table(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from tallymart.sources.layout import write_clustered

    df = spark.range(0, 60_000, 1, 6).select(
        F.pmod(F.xxhash64("id"), F.lit(500)).alias("customer_id"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).alias("product_id"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100))).alias("seller_id"), F.lit("2024-01-05").cast("date").alias("order_date"), "id",
    )
    path, columns = str(tmp_path / "fact"), ["customer_id", "product_id", "seller_id"]
    write_clustered(df, path, columns, files=64)
    assert sorted(r.id for r in spark.read.parquet(path).select("id").collect()) == list(range(60_000))
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/*/*.parquet")]
    assert len(files) > 50
    for c in columns:
        place = files[0].schema_arrow.names.index(c)
        spans = [(s.min, s.max) for f in files for g in range(f.num_row_groups) for s in [f.metadata.row_group(g).column(place).statistics]]
        for value in (3, 50, 99):  # 64 files are four places in each of three columns: a quarter of the files, half where ranges do not fit the places
            assert sum(low is not None and low <= value <= high for low, high in spans) <= 0.5 * len(spans), (c, value)
    hit = spark.read.parquet(path).where("customer_id = 77")
    assert hit.count() == df.where("customer_id = 77").count()


def test_stored_results_come_from_one_fact_and_are_made_once(spark, rows, tmp_path, monkeypatch):
    from tallymart.catalog import storage

    fact = spark.range(40).selectExpr("id AS order_id", "id % 3 AS customer_id", "CAST(id AS DECIMAL(12,2)) AS total_amount")
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: made.add(1) or x, "long")
    seen = []

    def results(stored_fact, *_):
        seen.append(stored_fact.inputFiles())
        return {"daily_sales": stored_fact.groupBy("customer_id").agg(F.sum("total_amount").alias("sum")).withColumn("customer_id", count.asNondeterministic()("customer_id"))}

    monkeypatch.setattr(load, "analysis_results", results)
    tables = SimpleNamespace(spark=spark, fact_sales=lambda: fact, customers=None, products=None, sellers=None)
    got = sorted(tuple(r) for r in storage.write_csv_results(tables).select("customer_id", F.col("sum").cast("int")).collect())
    assert got == [(r, sum(range(r, 40, 3))) for r in range(3)]
    assert seen[0] and all("/fact-" in f for f in seen[0])
    assert made.value == 3


def test_frames_differ_by_a_cell_and_by_how_often_a_row_is_there(rows):
    from tallymart.catalog.storage import differ

    one = rows("a int, b string", (1, "x"), (1, "x"), (None, None))
    assert not differ(one, rows("a int, b string", (None, None), (1, "x"), (1, "x")))
    assert differ(one, rows("a int, b string", (None, None), (1, "x")))
    assert differ(one, rows("a int, b string", (None, None), (1, "x"), (1, None)))
    assert differ(rows("a int, b string", (1, "x")), rows("a int, b string"))
