"""Text formatting, masking, lookups and request-style filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .aggregates import as_col, ratio

EMAIL_PATTERN = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"


def format_currency(c: Column | str, symbol: str = "$", decimals: int = 2) -> Column:
    """Sign, symbol, then the grouped amount: -$1,234.56."""
    amount = as_col(c)
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit(symbol), F.format_number(F.abs(amount), decimals))


def percentage_change(before: Column | str, after: Column | str) -> Column:
    """Change in percent to two digits; infinite from a zero base."""
    old, new = as_col(before).cast("double"), as_col(after).cast("double")
    return F.when(old == 0, F.lit(float("inf"))).otherwise(F.round(ratio(new - old, old) * 100, 2))


def mask_middle(c: Column | str) -> Column:
    """First three characters, ``***``, last two; a text under eight characters is hidden whole."""
    text = as_col(c)
    shown = F.concat(F.substring(text, 1, 3), F.lit("***"), F.right(text, F.lit(2)))
    return F.when(F.length(text) >= 8, shown).when(text.isNotNull(), F.lit("***"))


def mask_password(c: Column | str) -> Column:
    return F.when(as_col(c).isNotNull(), F.lit("********"))


def mask_card(c: Column | str) -> Column:
    """All but the last four characters become ``*``; under eight, all do."""
    text = as_col(c)
    shown = F.lpad(F.right(text, F.lit(4)), F.length(text), F.lit("*"))
    return F.when(F.length(text) >= 8, shown).otherwise(F.repeat(F.lit("*"), F.length(text)))


MASKS = {
    "email": mask_middle,
    "phone": mask_middle,
    "address": mask_middle,
    "password": mask_password,
    "credit_card": mask_card,
}


def mask_sensitive(df: DataFrame) -> DataFrame:
    """Mask every column whose name marks it as sensitive."""
    return df.withColumns({n: MASKS[n](n) for n in df.columns if n in MASKS})


def is_valid_email(c: Column | str) -> Column:
    return F.coalesce(as_col(c).rlike(EMAIL_PATTERN), F.lit(False))


def entry_key(prefix: str, *parts: Column | str) -> Column:
    """``prefix:part:part``, the same for the same parts."""
    return F.concat_ws(":", F.lit(prefix), *[as_col(p).cast("string") for p in parts])


def query_key(*parts: Column | str) -> Column:
    return F.concat(F.lit("query:"), F.sha2(F.concat_ws(":", *[as_col(p).cast("string") for p in parts]), 256))


def uuid_key(*parts: Column | str) -> Column:
    """A key in the form of a UUID, the same for the same parts; null is a part of its own.

    Drawn from the values, so a task that runs again gives the same key.
    """
    cells = [F.coalesce(as_col(p).cast("string"), F.lit("\x00")) for p in parts]
    return F.regexp_replace(F.md5(F.concat_ws("\x1f", *cells)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def lookup(c: Column | str, table: dict[str, str], default: str) -> Column:
    """Dictionary lookup with a default for unknown and null keys."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(c)), F.lit(default))


def api_filter(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """``x=v``, ``x_min=v``, ``x_max=v``, ``x=a,b`` and ``x_like=pattern``."""

    def condition(name: str, value: str) -> Column:
        if name in df.columns:
            kind = df.schema[name].dataType
            options = [F.lit(v.strip()).cast(kind) for v in str(value).split(",")]
            return F.col(name).isin(*options) if len(options) > 1 else F.col(name) == options[0]
        stem, _, suffix = name.rpartition("_")
        if stem not in df.columns or suffix not in ("min", "max", "like"):
            raise ValueError(f"unknown filter {name}")
        if suffix == "like":
            return F.col(stem).like(value)
        bound = F.lit(value).cast(df.schema[stem].dataType)
        return F.col(stem) >= bound if suffix == "min" else F.col(stem) <= bound

    if not params:
        return df
    return df.where(reduce(lambda a, b: a & b, [condition(k, v) for k, v in params.items()]))


def sort_by(df: DataFrame, sort: str, order: str = "asc", tie: str | None = None) -> DataFrame:
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    first = F.col(sort).asc() if order == "asc" else F.col(sort).desc()
    return df.orderBy(first, *([F.col(tie)] if tie else []))


def paginate(df: DataFrame, keys: list[str], page: int = 1, per_page: int = 100) -> DataFrame:
    """One page in key order.  The keys have to be unique for stable pages."""
    if page < 1 or not 1 <= per_page <= 1000:
        raise ValueError("page starts at 1 and per_page lies in 1..1000")
    return df.orderBy(*keys).offset((page - 1) * per_page).limit(per_page)


def page_totals(df: DataFrame, per_page: int = 100) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_count"),
        F.lit(per_page).alias("per_page"),
        F.ceil(n / F.lit(per_page)).cast("bigint").alias("total_pages"),
    )
