"""Repeated passages by a sparse suffix array.

Of all suffixes of all texts only those that begin at content-selected positions are
kept: in every window of neighbouring positions, the one whose next words have the
smallest hash.  Equal passages select equal positions.  The kept suffixes are sorted in
every task, which holds all suffixes with the same first words, and one that shares these
with neither neighbour is dropped.  From the others, matches are extended to the left as far as the selected
position before, and to the right to the wanted length: first in one piece for each
suffix, then word by word where the whole piece did not match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import arrow_rows, free_name, key_array, mix64, run_keys, session, split_words, stored, table, word_keys
from .registry import query

MIN_WORDS = 50
SEED_WORDS = 8  # words whose hash selects a position
WORD = re.compile(rb"[^ \t-\r]+")


class RunHashes:
    """64-bit hashes of any run of words of a text from running sums, in two families."""

    BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.back = [], []
        for base in self.BASES:
            # Powers of an odd base and of its inverse modulo 2**64.
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, pow(base, -1, 2**64)))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])]))
            self.back.append(down)

    def of(self, start: np.ndarray, end: np.ndarray, family: int) -> np.ndarray:
        return mix64((self.sums[family][end] - self.sums[family][start]) * self.back[family][start])


def anchors(words: np.ndarray, min_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected positions, and for each the first and last start of the passages of ``min_words`` that select it."""
    n, none = len(words), np.empty(0, np.int64)
    if n < min_words:
        return none, none, none
    seeds = run_keys(words, SEED_WORDS)[: n - min_words + window]
    # The high bits of the hash, then the position: the smallest is the leftmost of the smallest hashes.
    low_bits = np.uint64((1 << 24) - 1)
    least = (seeds & ~low_bits) | (np.arange(len(seeds), dtype=np.uint64) & low_bits)
    width = 1
    while width < window:  # smallest of each window, by doubling the width
        by = min(width, window - width)
        least = np.minimum(least[: len(least) - by], least[by:])
        width += by
    start = np.arange(len(least))
    first = start + (((least & low_bits).astype(np.int64) - start) & int(low_bits))
    # The position of a start's own window hangs on the passage alone; it never goes back as starts go on.
    at, low, many = np.unique(first, return_index=True, return_counts=True)
    return at, low, low + many - 1


HOT_RATE, HOT_KEYS, HOT_SALTS = 64, 10_000, 1024  # one document in so many is asked for frequent suffixes, so many of which are dealt so wide


def _frequent(docs: DataFrame, min_words: int, window: int) -> np.ndarray:
    """Keys of suffixes that occur often in a sample of the documents, a bounded number, in ascending order.

    They only decide which task a suffix goes to, never whether it is found.
    """
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(HOT_RATE)) == 0)
    counted = _suffixes(some, min_words, window).groupBy("key").agg(F.count("*").alias("n")).filter("n >= 8")
    return np.sort(np.array([r.key for r in counted.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()], np.int64))


def _suffixes(docs: DataFrame, min_words: int, window: int, frequent: np.ndarray | None = None) -> DataFrame:
    """A row for each kept suffix: key of its first words, key of its whole piece, place, and starts that hang on it.

    ``salt`` is above 0 for suffixes with one of the ``frequent`` keys.
    """
    first_words = min_words - window + 1
    hot = np.empty(0, np.int64) if frequent is None else frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = word_keys()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 6]
            for doc_id, text in arrow_rows(batch, "doc_id", "text"):
                if text is None:
                    continue
                words = key_array(split_words(text.encode()), keys)
                at, low, high = anchors(words, min_words, window)
                if len(at):
                    runs = RunHashes(words)
                    key = runs.of(at, at + first_words, 0)
                    piece = mix64(runs.of(low, high + min_words, 1) + (high - low).astype(np.uint64) * np.uint64(4096) + (at - low).astype(np.uint64))
                    parts.append([key.view(np.int64), piece.view(np.int64), np.full(len(at), doc_id), at, low, high])
            cols = [np.concatenate([p[i] for p in parts]) for i in range(6)]
            salt = np.zeros(len(cols[0]), np.int64)
            if len(hot):
                known = hot[np.minimum(np.searchsorted(hot, cols[0]), len(hot) - 1)] == cols[0]
                salt[known] = (mix64(cols[2][known].astype(np.uint64) * np.uint64(1 << 20) + cols[3][known].astype(np.uint64)) % np.uint64(HOT_SALTS)).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64 if i < 3 else np.int32)) for i, c in enumerate([*cols, salt])], ["key", "piece", "doc_id", "at", "low", "high", "salt"]
            )

    return docs.mapInArrow(run, "key long, piece long, doc_id long, at int, low int, high int, salt int")


def _shared_with_neighbour(sorted_rows: DataFrame) -> DataFrame:
    """Rows whose key equals a neighbour's, and those of frequent keys; the edge rows of a partition stay, as their neighbour may be elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose next neighbour is not known yet
        before: int | None = None
        at_edge = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            key = rows.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[at_edge or before == key[0]], same[:-1]]) | same if len(key) > 1 else np.empty(0, bool)
            keep |= rows.column(6).to_numpy()[:-1] > 0
            yield rows.slice(0, len(key) - 1).filter(pa.array(keep)).select(list(range(6)))
            if len(key) > 1:
                before, at_edge = int(key[-2]), False
            held = rows.slice(len(key) - 1)
        if held is not None:
            yield held.select(list(range(6)))

    return sorted_rows.mapInArrow(run, sorted_rows.drop("salt").schema)


def _windows(docs: DataFrame, open_rows: DataFrame, min_words: int, window: int) -> DataFrame:
    """Every start of the given suffixes with two keys: of the suffix and of its ``min_words`` words; ``at`` is the suffix's place."""
    first_words = min_words - window + 1
    wanted = open_rows.groupBy("doc_id").agg(F.collect_set(F.struct("at", "low", "high")).alias("pieces"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = word_keys()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 5]
            for doc_id, text, pieces in arrow_rows(batch, "doc_id", "text", "pieces"):
                runs = RunHashes(key_array(split_words(text.encode()), keys))
                at, low, high = (np.array([p[c] for p in pieces], np.int64) for c in ("at", "low", "high"))
                many = high - low + 1
                start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                key = np.repeat(runs.of(at, at + first_words, 0), many)
                parts.append([key.view(np.int64), runs.of(start, start + min_words, 1).view(np.int64), np.full(len(start), doc_id), start, np.repeat(at, many)])
            cols = [np.concatenate([p[i] for p in parts]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if i < 3 else np.int32)) for i, c in enumerate(cols)], ["key", "piece", "doc_id", "start", "at"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "pieces").mapInArrow(run, "key long, piece long, doc_id long, start int, at int")


def _with_first(rows: DataFrame, start: str, min_words: int) -> DataFrame:
    """Rows with the first place of their keys, and whether they repeat it (not lying over it)."""
    first = rows.groupBy("key", "piece").agg(F.min(F.struct("doc_id", start)).alias("f"), F.count("*").alias("k")).filter("k > 1")
    first = first.select("key", "piece", F.col("f.doc_id").alias("first_doc_id"), F.col(f"f.{start}").alias("first_start"), F.xxhash64("key", "piece").alias("_s"))
    placed = rows.withColumn("_s", F.xxhash64("key", "piece")).join(first, ["key", "piece", "_s"], "left").drop("_s")
    return placed.withColumn(
        "repeats", F.coalesce((F.col("first_doc_id") != F.col("doc_id")) | (F.col(start) - F.col("first_start") >= min_words), F.lit(False))
    )


def _seen_earlier(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Kinds of pieces of which a start was first seen in an earlier document than the whole piece, with the smallest such id."""
    leading = pieces.filter("first_doc_id = doc_id AND first_start = at").select("key", "piece", "doc_id", "at")
    earlier = starts.filter("first_doc_id < doc_id").groupBy("doc_id", "at").agg(F.min("first_doc_id").alias("earlier"))
    return leading.join(earlier, ["doc_id", "at"]).groupBy("key", "piece").agg(F.min("earlier").alias("first_doc_id"))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, window: int | None = None) -> DataFrame:
    """``(doc_id, start_word, n_words, first_doc_id)``: maximal spans of words that occurred before.

    A passage of ``min_words`` words (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case) repeats
    if the first equal one, by id and position, lies in another document or ends before it
    starts.  Overlapping and adjoining repeats make one span; ``first_doc_id`` is the
    smallest id that one of them was first seen in.  Every such passage is found, however
    often it occurs; the first one stays.  Null and shorter texts have no span, nor have
    rows without an id.  Equal rows that repeat an id are one document.  If texts differ
    under one id, use ``without_repeats``, which numbers the rows.
    """
    session(docs.sparkSession)
    window = window or min(20, min_words - SEED_WORDS)
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Keys are even hashes, so a task gets its share of them without sampling; a frequent one goes to many tasks.
    suffixes = _suffixes(docs, min_words, window, _frequent(docs, min_words, window)).repartition("key", "salt").sortWithinPartitions("key", "doc_id", "at")
    shared = stored(_shared_with_neighbour(suffixes), "repeat-suffixes")
    pieces = stored(_with_first(shared, "at", min_words), "repeat-pieces")
    # A piece that repeats settles all its starts; the first of its kind stands for the others in the finer step.
    starts = stored(_with_first(_windows(docs, pieces.filter("NOT repeats"), min_words, window), "start", min_words).filter("repeats"), "repeat-starts")
    # What the finer step finds for the first of its kind holds for the copies: they get a second row with the earlier document.
    kinds = stored(_seen_earlier(pieces, starts).withColumn("_s", F.xxhash64("key", "piece")), "repeat-kinds")
    copies = pieces.filter("repeats").drop("first_doc_id").withColumn("_s", F.xxhash64("key", "piece")).join(kinds, ["key", "piece", "_s"])
    found = pieces.filter("repeats").select("doc_id", "low", "high", "first_doc_id").unionAll(
        copies.select("doc_id", "low", "high", "first_doc_id")
    ).unionAll(
        starts.select("doc_id", F.col("start").alias("low"), F.col("start").alias("high"), "first_doc_id")
    ).select("doc_id", "low", (F.col("high") + min_words).alias("end"), "first_doc_id")
    along = Window.partitionBy("doc_id").orderBy("low", "end")
    return (
        found.withColumn("reach", F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("span", F.sum(F.when(F.col("low") <= F.col("reach"), 0).otherwise(1)).over(along))
        .groupBy("doc_id", "span").agg(F.min("low").alias("start_word"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
        .select("doc_id", F.col("start_word").cast("long").alias("start_word"), (F.col("end") - F.col("start_word")).cast("long").alias("n_words"), "first_doc_id")
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans ``(start, number)`` and the blanks after them."""
    data = text.encode()
    begins = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for start, many in sorted(spans):
        out.append(data[at : begins[start]])
        at = begins[start + many]
    out.append(data[at:])
    return b"".join(out).decode()


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number in the order of ids and, where rows repeat an id, of a hash of their texts; none without an id.

    Rows that are equal in both have one number.
    """
    number = F.col("doc_id").cast("long")
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count() == 0:
        return docs.withColumn(name, number)
    keys = docs.filter("doc_id IS NOT NULL").select(number.alias("_id"), F.xxhash64("text").alias("_hash")).distinct()
    # After a range sort, Spark's increasing ids follow its order.
    ranked = stored(keys.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash").select("*", F.monotonically_increasing_id().alias("_number")), "repeat-numbers")
    found = docs.alias("d").join(ranked.alias("k"), (F.col("d.doc_id").cast("long") == F.col("k._id")) & (F.xxhash64("d.text") == F.col("k._hash")), "left")
    return found.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("k._number").alias(name))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated passage cut out of ``text`` and ``n_chars`` made anew.

    A document that loses all its words is left out.  Other rows and columns, of whatever
    name, stay as they are, null and short texts and rows without an id among them.  What
    comes first is what stays: rows are ordered by id, rows that repeat an id by a hash of
    their texts, and equal ones of these are one document.
    """
    schema = docs.schema
    mine, cuts_name = free_name(docs, "number"), free_name(docs, "cuts")
    rows = _numbered(docs, mine)
    spans = repeated_spans(rows.select(F.col(mine).alias("doc_id"), "text"), min_words)
    cuts = spans.groupBy(F.col("doc_id").alias(mine)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(cuts_name))  # bounded by the text
    joined = rows.join(cuts, mine, "left").select(*[F.col(f"`{c}`") for c in schema.names], cuts_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, keep, chars = [], [], []
            for text, cuts in arrow_rows(batch, "text", cuts_name):
                if cuts:
                    text = cut_words(text, [(c["start_word"], c["n_words"]) for c in cuts])
                keep.append(not cuts or WORD.search(text.encode()) is not None)
                texts.append(text)
                chars.append(len(text) if cuts else None)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                n = batch.schema.get_field_index("n_chars")
                old = batch.column(n).to_pylist()
                batch = batch.set_column(n, batch.schema.field(n), pa.array([o if c is None else c for o, c in zip(old, chars)], batch.schema.field(n).type))
            yield batch.select(schema.names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, T.StructType(schema.fields))


REPEAT_SQL = """
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w
    FROM documents
), p AS (
    SELECT doc_id, CAST(unnest(range(0, len(w) - 49)) AS BIGINT) AS s, w FROM d WHERE len(w) >= 50
), k AS (
    SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS h FROM p
), f AS (
    SELECT doc_id, s, first(doc_id) OVER o AS fd, first(s) OVER o AS fs FROM k WINDOW o AS (PARTITION BY h ORDER BY doc_id, s)
), r AS (
    SELECT doc_id, s, fd, CASE WHEN s <= max(s + 50) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS head
    FROM f WHERE fd <> doc_id OR s - fs >= 50
), g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r)
SELECT doc_id, min(s) AS start_word, max(s) + 50 - min(s) AS n_words, min(fd) AS first_doc_id FROM g GROUP BY doc_id, span
"""


@query("op4_repeats", REPEAT_SQL)
def repeats(spark, sf_dir: str) -> DataFrame:
    """All spans of fifty or more words that occurred before, over all documents."""
    return repeated_spans(table(spark, sf_dir, "documents"))
