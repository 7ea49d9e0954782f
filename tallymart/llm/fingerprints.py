"""Document fingerprints: one-permutation MinHash, built from DataFrame functions only.

Every five-word shingle is hashed once; the high part of the hash names a bin and the
bin keeps its smallest hash.  An empty bin takes the value of an occupied one, chosen by
a hash of both bin numbers, so equal sets of occupied bins borrow alike.  The low-order
byte of each bin is stored as hex; chance agreement of bytes is taken out of the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import session, stored, table, words_of
from .registry import query

BINS = 128
SHINGLE = 5
LOW_BITS = 8


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of the ``size``-word shingles in ascending order; fewer words make one shingle."""
    words = words_of(text)

    def hashed(w: Column) -> Column:
        n = F.size(w)
        one = F.transform(F.array(F.array_join(w, " ")), lambda s: F.xxhash64(s))
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
        )
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, one).otherwise(many)

    # The words are bound once as a lambda variable, so they are not split again for each use.
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(words), hashed))))


def bin_minima(hashes: Column, bins: int = BINS) -> Column:
    """Of ascending hashes, the smallest of each occupied bin; the bin is the hash's high part."""
    shift = 64 - bins.bit_length() + 1
    place = lambda h: F.shiftrightunsigned(h, shift)

    def heads(h: Column) -> Column:
        first = F.filter(h, lambda x, i: (i == 0) | (place(x) != place(F.get(h, i - 1))))
        return F.transform(first, lambda x: F.struct(place(x).cast("int").alias("bin"), x.alias("x")))

    return F.element_at(F.transform(F.array(hashes), heads), 1)


def fingerprint(text: Column, bins: int = BINS) -> Column:
    """Hex of the low-order bytes of all bins; empty for a text without words (or null)."""
    filled = bin_minima(shingle_hashes(text), bins)
    low = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(2**LOW_BITS - 1)))), LOW_BITS // 4, "0")

    def packed(occupied: Column) -> Column:
        # Rendezvous of bin numbers: the same as probing bins in an order of its own for each empty bin.
        borrow = lambda b: F.array_min(
            F.transform(occupied, lambda o: F.struct(F.xxhash64(b, o["bin"]).alias("r"), o["x"].alias("x")))
        )["x"]
        dense = lambda own: F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: low(F.coalesce(F.try_element_at(own, b), borrow(b)))
        )
        full = F.transform(F.array_sort(occupied), lambda o: low(o["x"]))
        sparse = F.flatten(F.transform(F.array(F.map_from_entries(occupied)), dense))
        return F.array_join(F.when(F.size(occupied) == bins, full).otherwise(sparse), "")

    return F.element_at(F.transform(F.array(filled), lambda o: F.when(F.size(o) == 0, F.lit("")).otherwise(packed(o))), 1)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated share of common shingles, 0 to 1; two empty fingerprints are alike, one empty is unlike."""
    width = LOW_BITS // 4
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substr(a, i * width + 1, F.lit(width)) == F.substr(b, i * width + 1, F.lit(width))))
    chance = 2.0**-LOW_BITS
    share = F.least(F.greatest((agree / bins - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(share)


def neighbours(ids: DataFrame) -> DataFrame:
    """``(id, prev_id, prev_n)`` for distinct ids: the next smaller id and its ``n``; the smallest id has the largest.

    Ids are dealt by range and stored, then chained within each range; only the last id
    of each range, a row per partition, goes to the neighbour range.
    """
    dealt = stored(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("part").agg(F.max(F.struct("id", "n")).alias("end"))
    in_order = Window.orderBy("part")  # one row per partition
    last = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = ends.select("part", F.coalesce(F.lag("end").over(in_order), last).alias("before"))
    chain = Window.partitionBy("part").orderBy("id")
    return (
        dealt.withColumn("p", F.lag(F.struct("id", "n")).over(chain))
        .join(F.broadcast(before), "part")
        .withColumn("p", F.coalesce("p", "before"))
        .select("id", F.col("p.id").alias("prev_id"), F.col("p.n").alias("prev_n"))
    )


def edited_fingerprints(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, and their likeness.

    In an edited text the last quarter of the code points gives way to as many from the
    start of the next document by id (the first one after the last).  A null text is
    empty; a text without words has an empty fingerprint.  Rows that repeat an id are
    kept, each with its own result; as next document they count once, with the smallest
    start and the smallest fingerprint.  Rows without an id have no next document.
    """
    session(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    ids = named.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.char_length("text")).alias("n"))
    chain = stored(neighbours(ids), "chain")
    linked = named.join(chain, named.doc_id == chain.id)  # this shuffle of the texts is used again below
    starts = (
        linked.groupBy(F.col("prev_id").alias("id"))
        .agg(F.min(F.left("text", F.floor(F.col("prev_n") / 4).cast("int"))).alias("start"))
    )
    n, take = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    started = named.join(starts, named.doc_id == starts.id, "left").select("doc_id", "text", "start")
    both = started.unionAll(rows.filter("doc_id IS NULL").withColumn("start", F.lit(None).cast("string"))).select(
        "doc_id", "text", n.cast("long").alias("n_chars"),
        F.concat(F.left("text", n - take), F.left(F.coalesce("start", F.lit("")), take)).alias("edited"),
    )
    made = stored(
        both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    fingerprint(F.col("text"), bins).alias("fingerprint"), fingerprint(F.col("edited"), bins).alias("edited_fingerprint")),
        "fingerprints",
    )
    after = (
        made.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("f"))
        .join(chain, F.col("next_id") == chain.id).groupBy(F.col("prev_id").alias("id")).agg(F.min("f").alias("next_fingerprint"))
    )
    return made.join(after, made.doc_id == after.id, "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", F.lit("")), bins).alias("near_next"),
    )


@query("op8_fingerprints")
def fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
