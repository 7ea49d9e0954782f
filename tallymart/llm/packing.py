"""Best-fit packing of documents into sequences of several permitted lengths.

Texts longer than the largest length are cut into full sequences and a rest.  Pieces are
dealt by a hash of their document into shards and packed in windows, longest first:
a piece goes to the open bin that it fills best; without one, a bin is opened in the
length whose cost for each token that it can still get is least, given the lengths that
are still to come in the window.  At the end each bin shrinks to the smallest permitted
length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import session, table
from .registry import query

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 32  # what a sequence costs beside its tokens
PLACED = "doc_id long, piece int, start long, n_tokens int, bin_id string, bin_length int, bin_used int, offset int"


def opening_costs(lengths: Sequence[int], overhead: int) -> dict[int, int]:
    """Cost of a sequence of each permitted length: its tokens and a fixed share."""
    return {c: c + overhead for c in lengths}


def pack(sizes: np.ndarray, lengths: Sequence[int], overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Bin and offset of each piece, then final length and used tokens of each bin.

    Pieces are taken from the longest to the shortest, equal ones in the given order.
    Open bins are kept by their free room; a bit for each room that occurs finds the
    tightest fit at once.
    """
    lengths = sorted(lengths)
    costs, largest = opening_costs(lengths, overhead), lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    # Tokens in pieces of at most a given size that are not placed yet.
    left = np.bincount(sizes, minlength=largest + 1) * np.arange(max(largest, int(sizes.max(initial=0))) + 1)
    remaining = np.cumsum(left)
    by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms, used, opened = 0, [], []
    placed_of_size = 0
    at_size = -1
    for i in order.tolist():
        size = int(sizes[i])
        if size != at_size:
            at_size, placed_of_size = size, 0
        placed_of_size += size
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            # What may still come: shorter pieces whole, of this size those not placed yet.
            def worth(c: int) -> tuple[float, int]:
                rest = c - size
                more = int(remaining[min(rest, size)]) - (placed_of_size if rest >= size else 0)
                return costs[c] / (size + min(rest, max(0, more))), c

            room = min((c for c in lengths if c >= size), key=worth)
            b = len(used)
            used.append(0)
            opened.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    final = [next(c for c in lengths if c >= u) for u in used]
    return bins, offsets, final, used


def token_count(text: Column) -> Column:
    """Words of a text and one end token; a null text has the end token only."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long") + 1


def pack_documents(
    docs: DataFrame, n_tokens: Column, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, window: int = 50_000,
) -> DataFrame:
    """Place every piece of ``docs(doc_id, ...)`` in a bin.

    Returns ``doc_id, piece, start, n_tokens, bin_id, bin_length, bin_used, offset``: a row
    per piece, in order of ``start`` within its document.  Documents of no tokens (null
    or less than 1) take no part.  Rows that repeat an id are packed each; a null id is
    kept.  Only ids and lengths are shuffled.  A shard is packed in windows of at most
    ``window`` pieces, so no task holds more, whatever the number of rows of one id.
    """
    session(docs.sparkSession)
    largest = max(lengths)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens.cast("long").alias("n")).filter("n > 0")
    pieces = rows.agg(F.coalesce(F.sum(F.ceil(F.col("n") / largest)), F.lit(0))).first()[0]
    shards = max(1, -(-pieces // window))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        shard, number, count = None, 0, 0

        def flush() -> pa.RecordBatch:
            ids, valid, piece, size = (np.concatenate([h[i] for h in held]) for i in range(4))
            bins, offsets, final, used = pack(size, lengths, overhead)
            names = np.array([f"{shard}-{number}-{b}" for b in range(len(used))], object)
            final, used = np.array(final, np.int32), np.array(used, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~valid), pa.array(piece.astype(np.int32)), pa.array(piece * largest), pa.array(size.astype(np.int32)), pa.array(names[bins], pa.string()),
                 pa.array(final[bins]), pa.array(used[bins]), pa.array(offsets.astype(np.int32))],
                ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_used", "offset"],
            )

        for batch in batches:
            places = batch.column(0).to_numpy()
            for this in np.unique(places):  # rows come sorted by shard
                part = batch.filter(pa.array(places == this))
                if this != shard:
                    if count:
                        yield flush()
                    held, count, number, shard = [], 0, 0, this
                n = part.column(2).to_numpy()
                ids = part.column(1)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                # Long documents give many pieces: they are cut a window at a time.
                at, inside = 0, 0
                while at < len(n):
                    take, many = [], 0
                    while at < len(n) and many < window - count:
                        whole = -(-int(n[at]) // largest)
                        upto = min(whole, inside + window - count - many)
                        take.append((at, inside, upto))
                        many += upto - inside
                        at, inside = (at + 1, 0) if upto == whole else (at, upto)
                    row = np.repeat([t[0] for t in take], [t[2] - t[1] for t in take])
                    piece = np.concatenate([np.arange(t[1], t[2]) for t in take])
                    held.append((ids[row], known[row], piece, np.minimum(n[row] - piece * largest, largest)))
                    count += many
                    if count >= window:
                        yield flush()
                        held, count, number = [], 0, number + 1
        if count:
            yield flush()

    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "n").mapInArrow(place, PLACED)


@query("op2_packing")
def packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed by their words and an end token."""
    return pack_documents(table(spark, sf_dir, "documents"), token_count(F.col("text")))
