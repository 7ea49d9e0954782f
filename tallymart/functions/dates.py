"""Date arithmetic, date filters and dense time grids."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .aggregates import as_col

MICROS_PER_DAY = 86_400_000_000

# How a period name steps back by one.
PREVIOUS_PERIOD = {
    "day": "interval 1 day",
    "week": "interval 7 days",
    "month": "interval 1 month",
    "year": "interval 1 year",
}


def calendar_days(later: Column | str, earlier: Column | str) -> Column:
    """Difference of the two calendar dates."""
    return F.datediff(as_col(later), as_col(earlier))


def elapsed_days_floor(later: Column | str, earlier: Column | str) -> Column:
    """Whole elapsed days, rounded down: one hour early gives -1."""
    micros = F.unix_micros(as_col(later)) - F.unix_micros(as_col(earlier))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("int")


def elapsed_days_trunc(later: Column | str, earlier: Column | str) -> Column:
    """Whole elapsed days, cut towards zero: one hour early gives 0."""
    return F.extract(F.lit("DAY"), as_col(later) - as_col(earlier)).cast("int")


def parse_date(text: Column | str) -> Column:
    """``yyyy-MM-dd`` or ``yyyy-MM-ddTHH:mm:ss``; null for any other text."""
    c = as_col(text)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    )


def parse_iso(text: Column | str) -> Column:
    """Any ISO-8601 text Spark casts to a timestamp; null for dirty input."""
    return as_col(text).try_cast("timestamp")


def format_date(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd")


def day_key(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd")


def hour_key(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd HH:00:00")


def previous_period(c: Column | str, period: str) -> Column:
    """The same moment one period earlier; month ends are clamped."""
    if period not in PREVIOUS_PERIOD:
        raise ValueError(f"period must be one of {sorted(PREVIOUS_PERIOD)}")
    return as_col(c) - F.expr(PREVIOUS_PERIOD[period])


def date_range(start: str, end: str) -> tuple[dt.datetime, dt.datetime]:
    """Parse two bounds and refuse an end before its start."""
    first, last = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
    if last < first:
        raise ValueError("Invalid date range: end is before start")
    return first, last


def check_range(start, end) -> None:
    if start is not None and end is not None and str(end) < str(start):
        raise ValueError("Invalid date range: end is before start")


def moment(value) -> Column:
    """A literal timestamp from text, date or datetime."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(value).cast("timestamp")


def days_before(as_of, days: int) -> Column:
    return moment(as_of) - F.make_dt_interval(F.lit(days))


# The date that a stored table derives from a moment; it may be partitioned by it.
DERIVED_DATES = {"order_timestamp": "order_date"}


def in_stored_chunks(df: DataFrame, ts: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Bounds on a moment said again for the date and chunk columns derived from it.

    They keep the same rows, and let Spark skip the partitions of a stored table.
    """
    date = DERIVED_DATES.get(ts, ts)
    derived = {date: "day"} | {f"{date}_{chunk}": chunk for chunk in ("week", "month")}
    for name, unit in derived.items():
        if name in df.columns and name != ts:
            if low is not None:
                df = df.where(F.col(name) >= F.to_date(F.date_trunc(unit, low)))
            if high is not None:
                df = df.where(F.col(name) <= F.to_date(F.date_trunc(unit, high)))
    return df


def lookback(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``; no upper bound."""
    low = days_before(as_of, days)
    return in_stored_chunks(df, ts, low).where(F.col(ts) >= low)


def between_dates(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Both bounds inclusive."""
    check_range(start, end)
    low, high = moment(start), moment(end)
    return in_stored_chunks(df, ts, low, high).where(F.col(ts).between(low, high))


def half_open(df: DataFrame, ts: str, start, end) -> DataFrame:
    """start <= ts < end."""
    check_range(start, end)
    low, high = moment(start), moment(end)
    return in_stored_chunks(df, ts, low, high).where((F.col(ts) >= low) & (F.col(ts) < high))


def optional_date_filter(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Each bound is applied only where given; both inclusive."""
    check_range(start, end)
    df = in_stored_chunks(df, ts, None if start is None else moment(start), None if end is None else moment(end))
    bounds = []
    if start is not None:
        bounds.append(F.col(ts) >= moment(start))
    if end is not None:
        bounds.append(F.col(ts) <= moment(end))
    return df.where(reduce(lambda a, b: a & b, bounds)) if bounds else df


def time_grid(spark: SparkSession, start, end, step: str, name: str) -> DataFrame:
    """Every step from start (inclusive) to end (exclusive)."""
    last = moment(end) - F.expr("interval 1 microsecond")
    return spark.range(1).select(
        F.explode(F.sequence(moment(start), last, F.expr(f"interval {step}"))).alias(name)
    )


def grid_over(df: DataFrame, ts: str, unit: str, step: str, name: str) -> DataFrame:
    """Every period from the first to the last one that holds a row."""
    span = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")).where("_lo is not null")
    return span.select(
        F.explode(
            F.sequence(F.date_trunc(unit, "_lo"), F.date_trunc(unit, "_hi"), F.expr(f"interval {step}"))
        ).alias(name)
    )


def gap_fill(grid: DataFrame, rows: DataFrame, key: str, zero: tuple[str, ...] = ()) -> DataFrame:
    """Keep every grid point; the named measures become 0 where no row exists."""
    joined = grid.join(rows, key, "left")
    return joined.fillna(0, subset=list(zero)) if zero else joined
