"""Documents as chunks of coded words, so that word figures can be joined once per chunk.

A chunk holds the documents of a few megabytes of text: the distinct words once, and for
each document its words as numbers into that list.  Joining word counts then needs a row
for each distinct word of a chunk instead of one for each word of a text, and no task
ever holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, split_words

CHUNK_BYTES = 4 << 20
CHUNK = "chunk long, doc_ids array<long>, flags array<boolean>, lengths array<int>, codes binary, words array<binary>, learned array<int>"
_ARROW = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
    ("codes", pa.binary()), ("words", pa.list_(pa.binary())), ("learned", pa.list_(pa.int32())),
])


def pack_numbers(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Compressed numbers; all their low bytes come first, then the next ones, as these repeat more."""
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize)
    return raw.size.to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw.T.tobytes(), asbytes=True)


def unpack_numbers(data: bytes, kind: str = "<u4") -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).reshape(-1)


def coded_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of ``docs(doc_id, text, learn, flag)``; ``learned`` counts each word in rows with ``learn``.

    A chunk's number is made of its partition and its place there, so store the result
    before it is used twice.  A null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, flags, lengths, codes, learn, known, size = [], [], [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(codes) if codes else np.empty(0, np.int64)
            from_learned = every[np.repeat(np.array(learn, bool), lengths)] if len(every) else every
            counts = np.bincount(from_learned, minlength=len(known))
            row = [[part * 2**32 + number], [ids], [flags], [lengths], [pack_numbers(every)], [list(known)], [counts]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc_id, text, learns, flag in arrow_rows(batch, "doc_id", "text", "learn", "flag"):
                data = text.encode() if text else b""
                words = split_words(data)
                codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                ids.append(doc_id)
                flags.append(flag)
                learn.append(learns)
                lengths.append(len(words))
                size += len(data)
                if size >= chunk_bytes or len(ids) >= 50_000:
                    yield flush()
                    number += 1
                    ids, flags, lengths, codes, learn, known, size = [], [], [], [], [], {}, 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "learn", "flag").mapInArrow(run, CHUNK)


def learned_counts(chunks: DataFrame) -> DataFrame:
    """``(word, c)`` over all rows that are learned from."""
    pairs = chunks.select(F.explode(F.arrays_zip("words", "learned")).alias("w")).filter("w.learned > 0")
    return pairs.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.learned").alias("c"))


def joined_chunks(chunks: DataFrame, figures: DataFrame, use: Callable[[dict, dict[str, np.ndarray]], pa.RecordBatch], schema: str, columns: list[str]) -> DataFrame:
    """Bring ``figures(word, ...)`` to every chunk that has the word and apply ``use(chunk row, figures)`` to it.

    The figures come as an array of word numbers, ``word``, and one for each column.
    A word that very many chunks have is a hot key of the first join, which Spark splits.
    """
    asked = chunks.select("chunk", F.posexplode("words").alias("number", "word"))
    found = asked.join(figures, "word").select(F.col("chunk").alias("to"), "number", *columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["words", "learned"] if "words" in left.column_names else []).to_pylist()[0]
        if right.num_rows:
            got = {c: right.column(c).to_numpy() for c in ["number", *columns]}
        else:
            got = {c: np.empty(0, np.int64) for c in ["number", *columns]}
        return pa.Table.from_batches([use(row, got)])

    slim = chunks.select("chunk", "doc_ids", "flags", "lengths", "codes", F.size("words").alias("n_words"))
    return slim.groupBy("chunk").cogroup(found.groupBy("to")).applyInArrow(run, schema)
