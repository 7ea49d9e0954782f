import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymart.functions import dates, text
from tallymart.functions.quantiles import exact_quantiles, quantile_bins


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_three_meanings_of_days_between(rows):
    df = rows(
        "a timestamp, b timestamp",
        ("2024-01-02 01:00:00", "2024-01-01 23:00:00"),
        ("2024-01-01 22:00:00", "2024-01-01 23:00:00"),
    ).select(
        dates.calendar_days("a", "b"),
        dates.elapsed_days_floor("a", "b"),
        dates.elapsed_days_trunc(F.col("a"), F.col("b")),
    )
    assert [tuple(r) for r in df.collect()] == [(1, 0, 0), (0, -1, 0)]


def test_parse_date(spark):
    got = one(
        spark,
        dates.parse_date(F.lit("2024-01-31")),
        dates.parse_date(F.lit("2024-01-31T12:30:00")),
        dates.parse_date(F.lit("31.01.2024")),
        dates.parse_iso(F.lit("2024-01-01T12:00:00Z")),
        dates.parse_iso(F.lit("invalid-date")),
    )
    assert got == (
        dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 31, 12, 30), None, dt.datetime(2024, 1, 1, 12), None
    )


def test_previous_period_clamps_month_ends(spark):
    march = dates.moment("2024-03-31")
    got = one(spark, *[dates.previous_period(march, p) for p in ("day", "week", "month", "year")])
    assert got == tuple(dt.datetime(*d) for d in ((2024, 3, 30), (2024, 3, 24), (2024, 2, 29), (2023, 3, 31)))
    with pytest.raises(ValueError):
        dates.previous_period(march, "decade")


def test_ranges(spark, rows):
    with pytest.raises(ValueError, match="Invalid date range"):
        dates.date_range("2024-02-01", "2024-01-01")
    df = rows("ts timestamp", ("2024-01-01",), ("2024-01-02",), ("2024-01-03",))
    with pytest.raises(ValueError, match="Invalid date range"):
        dates.half_open(df, "ts", "2024-02-01", "2024-01-01")
    assert dates.half_open(df, "ts", "2024-01-01", "2024-01-03").count() == 2
    assert dates.between_dates(df, "ts", "2024-01-01", "2024-01-03").count() == 3
    assert dates.optional_date_filter(df, "ts").count() == 3
    assert dates.optional_date_filter(df, "ts", end="2024-01-02").count() == 2
    assert dates.lookback(df, "ts", 1, "2024-01-03").count() == 2


def test_currency(spark):
    money = text.format_currency
    got = one(
        spark,
        money(F.lit(1234.5678)),
        money(F.lit(1234.5678), decimals=3),
        money(F.lit(1234.5678), "€"),
        money(F.lit(0.0)),
        money(F.lit(-1234.56)),
    )
    assert got == ("$1,234.57", "$1,234.568", "€1,234.57", "$0.00", "-$1,234.56")


def test_percentage_change(spark):
    pairs = [(100, 150), (150, 100), (100, 100), (0, 100), (100, 0)]
    got = one(spark, *[text.percentage_change(F.lit(a), F.lit(b)) for a, b in pairs])
    assert got == (50.0, -33.33, 0.0, math.inf, -100.0)


def test_masking(spark, rows):
    df = rows(
        "email string, password string, credit_card string, name string",
        ("user@example.com", "secret123", "4111111111111111", "John Doe"),
    )
    assert tuple(text.mask_sensitive(df).first()) == ("use***om", "********", "************1111", "John Doe")


def test_email(spark):
    good = ["user@example.com", "user.name@example.co.uk", "user+tag@example.com"]
    bad = ["not-an-email", "@example.com", "user@", "user@.com", "", None]
    got = one(spark, *[text.is_valid_email(F.lit(x).cast("string")) for x in good + bad])
    assert got == (True,) * 3 + (False,) * 6


def test_lookup_and_keys(spark):
    table = {"SP": "Southeast"}
    got = one(
        spark,
        text.lookup(F.lit("SP"), table, "Other"),
        text.lookup(F.lit("XX"), table, "Other"),
        text.lookup(F.lit(None).cast("string"), table, "Other"),
        text.entry_key("order", F.lit(7), F.lit("x")),
    )
    assert got == ("Southeast", "Other", "Other", "order:7:x")


def test_api_filter_sort_and_pages(spark):
    df = spark.range(250).withColumn("name", F.concat(F.lit("n"), F.col("id") % 3))
    assert text.api_filter(df, {"id_min": "10", "id_max": "19"}).count() == 10
    assert text.api_filter(df, {"id": "1,2,300"}).count() == 2
    assert text.api_filter(df, {"name_like": "n%", "id": "5"}).count() == 1
    with pytest.raises(ValueError):
        text.api_filter(df, {"unknown": "1"})
    page = text.paginate(df, ["id"], page=3, per_page=100)
    assert [r.id for r in page.collect()] == list(range(200, 250))
    assert tuple(text.page_totals(df, 100).first()) == (250, 100, 3)
    assert text.sort_by(df, "id", "desc").first().id == 249
    with pytest.raises(ValueError):
        text.paginate(df, ["id"], page=0)


@pytest.mark.parametrize("accuracy", [100_000, 1000])
def test_exact_quantiles_match_pandas(spark, accuracy):
    """With the second accuracy the sketch is coarser than the table."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "x": np.concatenate([rng.lognormal(3, 2, 6000), np.full(3000, 7.25)]),
            "y": rng.integers(0, 40, 9000).astype(float),
        }
    )
    frame.loc[::50, "x"] = np.nan
    probs = [0.0, 0.2, 0.5, 0.8, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    got = exact_quantiles(df, {"x": probs, "y": probs}, accuracy=accuracy).first()
    for c in "xy":
        want = frame[c].dropna().quantile(probs).tolist()
        assert got[c] == pytest.approx(want, rel=1e-12)


def test_brackets_keep_few_values(spark):
    """On a large table only values near the wanted ranks reach the last step."""
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("x"))
    row = exact_quantiles(df, {"x": [0.5]}, accuracy=1000)
    assert row.first().x[0] == pytest.approx(df.toPandas().x.quantile(0.5), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.range(3).select(F.lit(None).cast("double").alias("x"))
    assert exact_quantiles(df, {"x": [0.5]}).first().x == [None]


def test_bins_match_qcut_and_survive_ties(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"id": range(500), "x": rng.normal(size=500), "tied": [1] * 450 + list(range(50))})
    df = spark.createDataFrame(frame)
    labels = [1, 2, 3, 4, 5]
    got = quantile_bins(df, {"x": ("b", labels), "tied": ("t", labels)}).orderBy("id").toPandas()
    assert got.b.tolist() == pd.qcut(frame.x, 5, labels=labels).astype(int).tolist()
    assert set(got.t[:450]) == {1} and got.t.max() == 5
    with pytest.raises(ValueError):
        quantile_bins(df, {"x": ("b", [1, 2]), "tied": ("t", labels)})


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 50])
def test_small_tables_have_exact_quantiles(spark, n):
    xs = np.random.default_rng(n).normal(size=n)
    probs = [0.05, 0.3, 0.4, 0.5, 0.77, 0.99]
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": xs})), {"x": probs}).first().x
    assert got == pytest.approx(np.quantile(xs, probs).tolist(), rel=1e-12)


def test_short_values_are_hidden_whole(spark):
    row = spark.sql("SELECT 'ab' AS email, 'abcd' AS phone, '123' AS credit_card, cast(null AS string) AS address")
    assert tuple(text.mask_sensitive(row).first()) == ("***", "***", "***", None)
