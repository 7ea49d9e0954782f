"""Exact quantiles and quantile bins over a whole table.

``percentile`` keeps every distinct value of a group in one task's memory.
Here a sketch first brackets each wanted rank; one more pass counts the rows
between the brackets and keeps only the values inside, about ``7 / accuracy``
of the rows.  Those are dealt into cells of equal width, counted per cell, and
ordered cell by cell in as many tasks as there are cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS = 1000


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], accuracy: int = 100_000) -> DataFrame:
    """One row; for each column an array with its interpolated quantiles.

    Same definition as pandas ``quantile`` and SQL ``percentile_cont``.  Nulls
    are left out; a column without values gives an array of nulls.  A rank
    outside its bracket, which the sketch's error bound rules out, raises.
    """
    margin = 3.0 / accuracy  # thrice the rank error of the sketch
    ordered = {name: sorted(set(probs)) for name, probs in wanted.items()}

    def sketch(name: str) -> Column:
        v = F.col(name).cast("double")
        low = F.percentile_approx(v, [max(p - margin, 0.0) for p in ordered[name]], accuracy)
        high = F.percentile_approx(v, [min(p + margin, 1.0) for p in ordered[name]], accuracy)
        return F.struct(low.alias("low"), high.alias("high")).alias(name)

    values = df.select(*wanted)
    brackets = values.agg(F.struct(*[sketch(c) for c in wanted]).alias("b")).scalar()

    def slot(name: str) -> Column:
        """Zone, cell and value: odd zones are brackets, even ones lie before, between and after them."""
        v, b = F.col(name).cast("double"), F.col(f"_b.{name}")
        zone, cell = F.lit(2 * len(ordered[name])), F.lit(0)
        for i in reversed(range(len(ordered[name]))):
            low, high = b["low"][i], b["high"][i]
            width = F.when(high > low, high - low)
            place = F.least(F.floor((v - low) / width * CELLS).cast("int"), F.lit(CELLS - 1))
            cell = F.when(v > high, cell).when(v >= low, F.coalesce(place, F.lit(0))).otherwise(0)
            zone = F.when(v > high, zone).when(v >= low, F.lit(2 * i + 1)).otherwise(2 * i)
        inside = zone % 2 == 1
        return F.when(
            v.isNotNull(),
            F.struct(
                F.lit(name).alias("metric"), zone.alias("zone"), cell.alias("cell"),
                F.when(inside, v).alias("v"), v.alias("value"),
            ),
        )

    place = ["metric", "zone", "cell"]
    counts = (
        values.withColumn("_b", brackets)
        .select(F.explode(F.array(*[slot(c) for c in wanted])).alias("s"))
        .where("s is not null")
        .select("s.*")
        .groupBy(*place, "v")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    # One row per cell: few, whatever the table's size.
    along = W.partitionBy("metric").orderBy("zone", "cell")
    cells = counts.groupBy(*place).agg(F.sum("rows").alias("held"))
    cells = cells.select(
        *place, (F.sum("held").over(along) - F.col("held")).alias("before"), F.sum("held").over(W.partitionBy("metric")).alias("n")
    )
    in_cell = W.partitionBy(*place).orderBy("v")
    ranked = counts.join(cells, place).withColumn("upto", F.col("before") + F.sum("rows").over(in_cell))

    def at(name: str, rank: Column) -> Column:
        """Value of a rank; between brackets only the first and the last value of a gap are known."""
        mine, gap, start = F.col("metric") == name, F.col("v").isNull(), F.col("upto") - F.col("rows")
        hit = F.when(~gap & (start <= rank) & (F.col("upto") > rank), F.col("v"))
        edge = F.when(gap & (start == rank), F.col("lo")).when(gap & (F.col("upto") - 1 == rank), F.col("hi"))
        return F.min(F.when(mine, F.coalesce(hit, edge)))

    cells_out = []
    for name, probs in wanted.items():
        cells_out.append(F.max(F.when(F.col("metric") == name, F.col("n"))).alias(f"{name}_n"))
        for i, p in enumerate(probs):
            rank = F.lit(p) * (F.col("n") - 1)
            cells_out.append(at(name, F.floor(rank)).alias(f"{name}_{i}_lo"))
            cells_out.append(at(name, F.ceil(rank)).alias(f"{name}_{i}_hi"))
            fraction = F.max(F.when(F.col("metric") == name, rank - F.floor(rank)))
            cells_out.append(fraction.alias(f"{name}_{i}_f"))
    row = ranked.agg(*cells_out)

    def blend(name: str, i: int) -> Column:
        low, high = F.col(f"{name}_{i}_lo"), F.col(f"{name}_{i}_hi")
        missed = F.col(f"{name}_n").isNotNull() & (low.isNull() | high.isNull())
        known = low + (high - low) * F.col(f"{name}_{i}_f")
        return F.when(missed, F.raise_error(F.lit(f"a rank of {name} lies outside its bracket")).cast("double")).otherwise(known)

    return row.select(
        *[F.array(*[blend(c, i) for i in range(len(p))]).alias(c) for c, p in wanted.items()]
    )


def quantile_edges(df: DataFrame, columns: list[str], q: int) -> Column:
    """The q - 1 inner edges of each column, as one struct of arrays."""
    probs = [i / q for i in range(1, q)]
    row = exact_quantiles(df, {c: probs for c in columns})
    return row.select(F.struct(*columns)).scalar()


def bin_label(value: Column, edges: Column, labels: list) -> Column:
    """Label of the first bin whose upper edge is not below the value.

    With repeated edges the lowest bin wins, so heavy ties never raise.
    """
    label = F.when(value <= edges[0], F.lit(labels[0]))
    for i in range(1, len(labels) - 1):
        label = label.when(value <= edges[i], F.lit(labels[i]))
    return label.when(value.isNotNull(), F.lit(labels[-1]))


def quantile_bins(df: DataFrame, bins: dict[str, tuple[str, list]]) -> DataFrame:
    """Add ``{column: (new column, labels)}`` by equal-count bins.

    All columns must use the same number of labels; they share one pass.
    """
    sizes = {len(labels) for _, labels in bins.values()}
    if len(sizes) != 1:
        raise ValueError("all bin columns need the same number of labels")
    edges = quantile_edges(df, list(bins), sizes.pop())
    with_edges = df.withColumn("_edges", edges)
    return with_edges.withColumns(
        {
            out: bin_label(F.col(c).cast("double"), F.col(f"_edges.{c}"), labels)
            for c, (out, labels) in bins.items()
        }
    ).drop("_edges")
