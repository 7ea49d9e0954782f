"""Near-duplicate documents with SetSketch registers.

Each document's set of word shingles is summarised in registers that hold exponentially
spaced, truncated minima of its elements' hashes; registers of a union are the larger of
both.  Groups of neighbouring registers are band keys, so similar sets meet in some
band.  Pairs that meet are judged by the likelihood of their similarity given all
registers and both set sizes, and what may reach the limit is confirmed on full sets.

Documents with equal sets are one class from the start.  Within a band, members are
compared with one hub in two orders; confirmed links join components.  Only bands that
still hold several components are then searched in full, block by block, for links
between components, so no link is lost and no band's pairs are listed as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, components, mix64, session, shingle_set, stored, table, word_keys
from .registry import query

REGISTERS = 241  # a prime, so that steps of any width visit every register
BAND_ROWS, BANDS = 5, 48
BASE, RATE, LIMIT = 1.001, 20.0, 65535
BLOCK = 512
# Of a register's agreement at the limit of 0.8, five standard deviations over 241 registers.
MARGIN = 0.13


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set of 64-bit keys.

    An element has a random register order and increasing values in it; a register keeps
    the smallest value (largest exponent).  All elements take one step at a time, and
    those whose values can no longer change a register of their set drop out.
    """
    m = REGISTERS
    out = np.zeros((len(sets), m), np.uint16)
    flat = out.reshape(-1)
    key = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    start = (mix64(key ^ np.uint64(0xA5A5)) % np.uint64(m)).astype(np.int64)
    stride = (mix64(key ^ np.uint64(0x5A5A)) % np.uint64(m - 1)).astype(np.int64) + 1
    value = np.zeros(len(key))
    low = np.zeros(len(sets), np.uint16)
    for j in range(m):
        if not len(key):
            break
        u = ((mix64(key + np.uint64(j * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        value = value - np.log(u) / (RATE * (m - j))
        k = np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE)), 0, LIMIT).astype(np.uint16)
        live = k > low[owner]
        key, owner, start, stride, value, k = key[live], owner[live], start[live], stride[live], value[live], k[live]
        np.maximum.at(flat, owner * m + (start + j * stride) % m, k)
        if j < 8 or j % 8 == 0:
            low = out.min(axis=1)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches whose set sizes are known."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]
    above, below = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    likelihood = more[:, None] * np.log(above) + less[:, None] * np.log(below) + same[:, None] * np.log(np.maximum(1 - above - below, 1e-12))
    return np.take_along_axis(grid, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    rows = sketches[:, : BANDS * BAND_ROWS].reshape(len(sketches), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key.view(np.int64)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def sketch_documents(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n_shingles, digest, registers)`` of every document; digest and registers null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = word_keys()
        for batch in batches:
            sets = [shingle_set(t, keys, size) for (t,) in arrow_rows(batch, "text")]
            sketches = set_sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.astype("<u2").tobytes() if len(s) else None for s, r in zip(sets, sketches)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_registers(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])

    return classes.select("id", "registers").mapInArrow(run, "key long, id long")


def _judged(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``(a, b, est)`` of pairs whose likely similarity may reach the limit."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    # The first side is joined on an id that repeats (a hub); its hot rows are split by Spark.
    whole = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                est = estimate(_registers(batch.column(2)), _registers(batch.column(4)), batch.column(1).to_numpy(), batch.column(3).to_numpy())
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(est)], ["a", "b", "est"])
                yield out.filter(pa.array(est >= least - MARGIN))

    return whole.select("a", "n_a", "r_a", "n_b", "r_b", "b").mapInArrow(run, "a long, b long, est double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets satisfy ``100 * common >= percent * union``."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("elements").alias(f"e_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for e_a, e_b in arrow_rows(batch, "e_a", "e_b"):
                a, b = np.frombuffer(e_a, "<u8"), np.frombuffer(e_b, "<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "e_a", "e_b")
    return whole.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = word_keys()
        for batch in batches:
            sets = [shingle_set(t, keys, size).astype("<u8").tobytes() for (t,) in arrow_rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "elements"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    # Rows that repeat an id may differ; the set of the class is the one whose digest it had, see link_documents.
    return wanted.mapInArrow(run, "id long, elements binary")


class _Links:
    """Confirmed links so far and the components that they make."""

    def __init__(self, spark, sets: DataFrame, percent: int):
        self.spark, self.sets, self.percent = spark, sets, percent
        self.edges: DataFrame | None = None
        self.labels = spark.createDataFrame([], "node long, component long")

    def label(self, rows: DataFrame, name: str, out: str) -> DataFrame:
        labels = self.labels.select(F.col("node").alias(name), F.col("component").alias(out))
        return rows.join(labels, name, "left").withColumn(out, F.coalesce(out, name))

    def between(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        return self.label(self.label(pairs, "a", "c_a"), "b", "c_b").filter("c_a <> c_b").drop("c_a", "c_b")

    def add(self, pairs: DataFrame) -> None:
        """Confirm pairs and join the components of those that hold."""
        if pairs.limit(1).count() == 0:
            return
        found = stored(_confirmed(pairs.select("a", "b"), self.sets, self.percent), "near-links")
        self.edges = found if self.edges is None else self.edges.unionAll(found)
        self.labels = components(self.edges, "near-components")

    def resolve(self, pairs: DataFrame) -> None:
        """Confirm the likeliest pairs of each document, then all others that still lie between components."""
        rank = Window.partitionBy("b").orderBy(F.desc("est"), "a")
        first = stored(pairs.withColumn("r", F.row_number().over(rank)).filter("r <= 4").select("a", "b"), "near-first")
        self.add(first)
        self.add(stored(self.between(pairs.select("a", "b").join(first, ["a", "b"], "left_anti")), "near-others"))


def _compact(classes: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, n, bands, short)``: the low halves of band keys and of the shingle keys, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bands = band_keys(_registers(batch.column(2))).astype("<u4")
                short = [np.sort(np.frombuffer(e, "<u8").astype("<u4")).tobytes() for e in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bands], pa.binary()), pa.array(short, pa.binary())], ["id", "n", "bands", "short"]
                )

    whole = classes.join(ids, "id", "left_semi").join(sets, "id").select("id", "n", "registers", "elements")
    return whole.mapInArrow(run, "id long, n long, bands binary, short binary")


def _block_links(members: DataFrame, compact: DataFrame, percent: int) -> DataFrame:
    """``(a, b, est)``: likely links between components of a band, for bands that hold several.

    ``members(key, id, component)``.  Members outside the band's largest component meet
    all members, in blocks of about ``BLOCK`` rows each.  The sets of shortened shingle
    keys are compared in the task: that may count a chance agreement as common but never
    misses a link.  A pair is looked at in the first band that it shares only, and of
    the links between a member and one component the three best are given out.
    """
    by_part = members.groupBy("key", "component").agg(F.count("*").alias("size"))
    bands = by_part.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("n_all"), F.count("*").alias("parts"))
    bands = bands.filter("parts > 1").select(
        "key", F.col("top.component").alias("main"), F.ceil((F.col("n_all") - F.col("top.size")) / BLOCK).cast("int").alias("rows"),
        F.ceil(F.col("n_all") / BLOCK).cast("int").alias("cols"),
    )
    spread = F.xxhash64("key")
    known = members.withColumn("_s", spread).join(bands.withColumn("_s", spread), ["key", "_s"]).drop("_s").join(compact, "id")
    known = known.withColumn("outside", F.col("component") != F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    base = ("key", "id", "component", "n", "bands", "short")
    asking = known.filter("outside").select(*base, place("rows").alias("i"), every("cols").alias("j"), F.lit(0).alias("side"))
    asked = known.select(*base, every("rows").alias("i"), place("cols").alias("j"), F.lit(1).alias("side"))
    cells = asking.unionAll(asked).withColumn("cell", F.xxhash64("key", "i", "j"))

    def cell_links(t: pa.Table) -> pa.RecordBatch:
        side, ids, part, n, key = (t.column(c).to_numpy() for c in ("side", "id", "component", "n", "key"))
        band = np.frombuffer(b"".join(t.column("bands").to_pylist()), "<u4").reshape(len(ids), BANDS)
        here = key.astype(np.int64).astype(np.uint32)
        short = [np.frombuffer(e, "<u4") for e in t.column("short").to_pylist()]
        out: list[tuple[int, int, float]] = []
        others = np.flatnonzero(side == 1)
        for q in np.flatnonzero(side == 0):
            fit = others[(part[others] != part[q]) & (100 * np.minimum(n[others], n[q]) >= percent * np.maximum(n[others], n[q]))]
            if not len(fit):
                continue
            same = band[fit] == band[q]
            fit = fit[band[q][same.argmax(axis=1)] == here[q]]
            if not len(fit):
                continue
            mine = short[q]
            flat = np.concatenate([short[o] for o in fit])
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            starts = np.cumsum([0, *(len(short[o]) for o in fit[:-1])])
            common = np.add.reduceat((mine[at] == flat).astype(np.int64), starts)
            union = n[fit] + n[q] - common
            fit, share = fit[100 * common >= percent * union], (common / np.maximum(union, 1))[100 * common >= percent * union]
            given: dict[int, int] = {}
            for o, x in sorted(zip(fit.tolist(), share.tolist()), key=lambda z: -z[1]):
                c = int(part[o])
                if given.get(c, 0) < 3:
                    given[c] = given.get(c, 0) + 1
                    out.append((int(min(ids[o], ids[q])), int(max(ids[o], ids[q])), x))
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["a", "b", "est"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cell = t.column("cell").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
            for at, to in zip(cuts[:-1], cuts[1:]):
                yield cell_links(t.slice(at, to - at))
            rest = t.slice(cuts[-1]) if len(cuts) else None
        if rest is not None and rest.num_rows:
            yield cell_links(rest)

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "side", *base).mapInArrow(search, "a long, b long, est double")


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  A text of fewer than
    ``size`` words is one shingle; one without words (or null) has an empty set and is
    linked with nothing.  ``component_id`` is the smallest id reachable over links with
    ``100 * common >= percent * union``; a row is kept if that is its own id.  Rows that
    repeat an id are linked as one document.  Rows without an id are linked with nothing:
    their component is null and they are kept.
    """
    spark = session(docs.sparkSession)
    least = percent / 100
    drawn = stored(sketch_documents(docs, size), "near-sketches")
    usable = drawn.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Rows that repeat an id with different sets are linked as rows first.
    if usable.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").limit(1).count():
        return _link_rows(docs, size, percent)
    classes = stored(
        usable.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "registers")).alias("c"))
        .select("digest", F.col("c.id").alias("id"), F.col("c.n").alias("n"), F.col("c.registers").alias("registers")),
        "near-classes",
    )
    bands = stored(_bands(classes), "near-bands")
    full = bands.groupBy("key").agg(
        F.count("*").alias("k"),
        *[F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id"))["id"].alias(f"hub{r}") for r in (0, 1)],
    ).filter("k > 1")
    spread = F.xxhash64("key")
    shared = stored(
        bands.withColumn("_s", spread).join(full.select("key", "hub0", "hub1").withColumn("_s", spread), ["key", "_s"]).drop("_s"), "near-shared"
    )
    star = shared.select("id", F.explode(F.array("hub0", "hub1")).alias("hub")).filter("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
    ).distinct()
    pairs = stored(_judged(star, classes, least), "near-judged")
    sets = stored(_sets(docs, shared.select("id").distinct(), size), "near-sets")
    links = _Links(spark, sets, percent)
    links.resolve(pairs)
    members = links.label(shared.select("key", "id"), "id", "component")
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    members = members.withColumn("_s", spread).join(mixed.withColumn("_s", spread), ["key", "_s"]).drop("_s")
    members = stored(members, "near-mixed")
    compact = stored(_compact(classes, sets, members.select("id").distinct()), "near-compact")
    # Full sets have the last word; what is confirmed here joins components for good.
    links.add(stored(_block_links(members, compact, percent).groupBy("a", "b").agg(F.max("est").alias("est")), "near-rest"))
    own = drawn.select("doc_id", "n_shingles", "digest").join(classes.select("digest", F.col("id").alias("class_id")), "digest", "left")
    return links.label(own, "class_id", "component").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def _link_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``link_documents`` where rows repeat an id with different texts.

    Each different row gets a number of its own, numbers are linked, and an id joins
    the components of all its rows.
    """
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("row_id", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))), "near-rows"
    )
    found = stored(link_documents(rows.select(F.col("row_id").alias("doc_id"), "text"), size, percent), "near-row-links")
    ids = rows.select("doc_id", F.col("row_id").alias("r")).distinct().join(
        found.select(F.col("doc_id").alias("r"), "component_id").distinct(), "r")
    first = ids.groupBy("component_id").agg(F.min("doc_id").alias("a"))
    labels = components(ids.join(first, "component_id").select("a", F.col("doc_id").alias("b")), "near-ids")
    sized = found.select(F.col("doc_id").alias("row_id"), "n_shingles").distinct()
    known = rows.filter("row_id IS NOT NULL").select("doc_id", "row_id").join(sized, "row_id").select("doc_id", "n_shingles")
    whole = known.unionAll(found.filter("doc_id IS NULL").select("doc_id", "n_shingles"))
    return whole.join(labels, whole.doc_id == labels.node, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


@query("op10_near_duplicates")
def near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their four-word shingles."""
    return link_documents(table(spark, sf_dir, "documents"), size=4)
