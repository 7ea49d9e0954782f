"""Quality of documents by the perplexity of a modified Kneser-Ney model of trusted text.

The model interpolates word trigrams, bigrams and single words.  Its counts come from all
trusted documents of the learned half.  Words are numbered through; counted n-grams lie in
blocks of sorted numbers, dealt to buckets by a hash of their last two words, as many as
the text needs, so no part of the model that grows with the text is held by the driver or
one task.  Every document is scored whole: chunks of coded documents ask the buckets for
their distinct words and then for their distinct pairs and triples, and get the counts back
in the order in which they asked.  A document is rejected if its perplexity exceeds a
quantile, specific to its language, of trusted documents that the model has not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .chunks import pack_numbers, unpack_numbers
from .common import arrow_rows, drop_scratch, key_array, mix64, noted_scratch, session, shuffles_removed, smallest_of, split_words, stored, table, word_keys
from .registry import query

PER_LANG = 500  # trusted documents of a language that ``rate_documents`` learns from unless told to learn from all
QUANTILE, SLACK = 0.995, 1.25
UNKNOWN, START, END, FIRST = 0, 1, 2, 3
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
PARTS = 4  # documents are scored in so many parts
PART_TOKENS = 200_000  # tokens rated at once, so that what is made of each stays small
CHUNK = "chunk long, doc_ids array<long>, langs array<string>, lengths array<int>, codes binary, words binary, counts binary"
ASKED = "bucket int, to long, b binary, c binary, per binary, a binary"
BLOCK = "bucket int, contexts boolean, b binary, c binary, per binary, a binary, n binary"
FOUND = "to long, bucket int, found binary"
WORD_FIGURES = ["number", "n", "total", "once", "twice", "more"]
SCORED = "doc_id long, lang string, n_tokens long, log_p double"
LOW = (1 << 32) - 1

# Keys of the n-grams of a small model, which can be looked at as one table.
DIGIT = 1 << 21
PAIR = DIGIT - 1  # in the first place of a key: a key of two words


def key_of(a, b, c):
    return (a * DIGIT + b) * DIGIT + c


def trigram_keys(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of texts with their ends: the two numbers before it, its own, and its text."""
    sizes = lengths + 1
    owner = np.repeat(np.arange(len(lengths)), sizes)
    last = np.full(len(owner), END, np.int64)
    inside = np.ones(len(owner), bool)
    inside[np.cumsum(sizes) - 1] = False
    last[inside] = codes
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.full(len(owner), START, np.int64), np.full(len(owner), START, np.int64)
    one[1:] = np.where(place[1:] >= 1, last[:-1], START)
    two[2:] = np.where(place[2:] >= 2, last[:-2], START)
    return two, one, last, owner


def _batch(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows as a table of flat columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


class Grams:
    """Distinct pairs ``b << 32 | c`` and triples ``place of the pair << 32 | a``, ascending, and where each token has its own."""

    def __init__(self, pair: np.ndarray, a: np.ndarray):
        self.pairs, self.of_pair = np.unique(pair, return_inverse=True)
        self.triples, self.of_triple = np.unique(self.of_pair[: len(a)] << 32 | a, return_inverse=True)

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice, slice]]]:
        """Orders of pairs and triples by bucket, and each bucket's parts of them."""
        bucket = (mix64(self.pairs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        of_triple = bucket[self.triples >> 32]
        pairs, triples = np.argsort(bucket, kind="stable"), np.argsort(of_triple, kind="stable")
        here, first = np.unique(bucket[pairs], return_index=True)
        cuts = np.append(first, len(pairs)), np.append(np.searchsorted(of_triple[triples], here), len(triples))
        return pairs, triples, [(int(k), slice(cuts[0][i], cuts[0][i + 1]), slice(cuts[1][i], cuts[1][i + 1])) for i, k in enumerate(here)]

    def packed(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[bytes, ...]]]:
        """Each bucket with its pairs, its triples and these as bytes."""
        by_pair, by_triple, parts = self.dealt(buckets)
        per = np.bincount(self.triples >> 32, minlength=len(self.pairs))
        for bucket, some, more in parts:
            pairs, triples = by_pair[some], by_triple[more]
            numbers = self.pairs[pairs] >> 32, self.pairs[pairs] & LOW, per[pairs], self.triples[triples] & LOW
            yield bucket, pairs, triples, tuple(pack_numbers(x) for x in numbers)


def _unpacked(b: bytes, c: bytes, per: bytes, a: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, the place of each triple's pair, and each triple's first number."""
    pairs = unpack_numbers(b).astype(np.int64) << 32 | unpack_numbers(c).astype(np.int64)
    return pairs, np.repeat(np.arange(len(pairs)), unpack_numbers(per)), unpack_numbers(a).astype(np.int64)


def _coded(docs: DataFrame, counted: bool = False) -> DataFrame:
    """Chunks of ``docs(doc_id, text, lang)``: the keys of the distinct words, each word as a place among them and, if ``counted``, their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, part, number = word_keys(), TaskContext.get().partitionId(), 0
        schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())),
                            ("codes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words, codes, counts = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
            by_count = np.argsort(-counts, kind="stable")  # frequent words have small codes, which take less room
            rank = np.empty(len(words), np.int64)
            rank[by_count] = np.arange(len(words))
            counts = pack_numbers(counts[by_count]) if counted else b""
            row = [[part * 2**32 + number], *([[h[i] for h in held]] for i in range(2)), [[len(h[2]) for h in held]],
                   [pack_numbers(rank[codes])], [words[by_count].tobytes()], [counts]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, text, lang in arrow_rows(batch, "doc_id", "text", "lang"):
                held.append((doc_id, lang, key_array(split_words(text.encode()), keys) if text else np.empty(0, np.uint64)))
                size += len(text or "")
                if size >= CHUNK_BYTES or len(held) >= 50_000:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return docs.select("doc_id", "text", "lang").mapInArrow(run, CHUNK)


def _found_words(chunks: DataFrame, words: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """The given columns of ``words(word, number, ...)`` for the distinct words of each chunk; zeros for words without a row."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in arrow_rows(batch, "chunk", "words"):
                word = np.sort(np.frombuffer(data, np.uint64))
                bucket, first = np.unique((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
                cuts = np.append(first, len(word))
                yield from _batch("bucket int, to long, words binary", [(int(k), chunk, word[cuts[i] : cuts[i + 1]].tobytes()) for i, k in enumerate(bucket)]).to_batches()

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("word").to_numpy().view(np.uint64) if right.num_rows else np.empty(0, np.uint64)
        order = np.argsort(known)
        known = known[order]
        values = [np.append(right.column(c).to_numpy()[order] if right.num_rows else [], 0).astype(np.int64) for c in columns]
        out = []
        for row in left.to_pylist():
            word = np.frombuffer(row["words"], np.uint64)
            at = np.searchsorted(known, word)
            at[np.append(known, 0)[at] != word] = len(known)
            out.append((row["to"], row["bucket"], pack_numbers(np.concatenate([v[at] for v in values]), "<u8")))
        return _batch(FOUND, out)

    asked = chunks.mapInArrow(ask, "bucket int, to long, words binary")
    place = F.shiftright(F.shiftrightunsigned("word", 32) * F.lit(buckets), 32).cast("int")
    return asked.groupBy("bucket").cogroup(words.select(place.alias("bucket"), "word", *columns).groupBy("bucket")).applyInArrow(find, FOUND)


def _joined(rows: list[dict], words: bytes, columns: int) -> np.ndarray:
    """What the buckets answered for the distinct words of one chunk, which were asked for in ascending order."""
    parts = [unpack_numbers(r["found"], "<u8").astype(np.int64).reshape(columns, -1) for r in sorted(rows, key=lambda r: r["bucket"])]
    out = np.empty((columns, len(words) // 8), np.int64)
    out[:, np.argsort(np.frombuffer(words, np.uint64))] = np.concatenate([out[:, :0], *parts], axis=1)
    return out


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    if not n[0]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    each = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.1), i - 0.1) for i, d in zip((1, 2, 3), each))])


def _pair_counts(pairs: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words come before a pair; nothing comes before a start, so pairs with it count as often as they occur."""
    size = len(pairs)
    return np.where(pairs >> 32 == START, np.bincount(of, n, size), np.bincount(of, minlength=size)).astype(np.int64)


def _classes(of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The total of the counts of each context, and how many of them are 1, 2 and more."""
    return np.stack([np.bincount(of, n, size), *(np.bincount(of[np.minimum(n, 3) == k], minlength=size) for k in (1, 2, 3))]).astype(np.int64)


def _rest(classes: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What contexts leave to shorter ones."""
    return np.where(classes[0] > 0, d[1:] @ classes[1:] / np.maximum(classes[0], 1), 1.0)


def _share(n: np.ndarray, total: np.ndarray | float, d: np.ndarray) -> np.ndarray:
    """Discounted probability of what occurs ``n`` times in a context."""
    return (n - d[np.minimum(n, 3)]) / np.maximum(total, 1)


class Part:
    """Counts of the pairs, triples and contexts in blocks of one bucket."""

    def __init__(self, blocks: list[dict]):
        pair, of, first, n, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        context, classes = [np.empty(0, np.int64)], [np.empty((4, 0), np.int64)]
        for block in blocks:
            pairs, place, a = _unpacked(*(block[c] for c in ("b", "c", "per", "a")))
            counts = unpack_numbers(block["n"], "<u8").astype(np.int64)
            if block["contexts"]:
                context.append(pairs)
                classes.append(counts.reshape(4, -1))
            else:
                pair.append(pairs)
                of.append(place + size)
                first.append(a)
                n.append(counts)
                size += len(pairs)
        pair, of = np.concatenate(pair), np.concatenate(of)
        grams = Grams(pair[of], np.concatenate(first))
        self.pairs, self.triples = grams.pairs, grams.triples
        self.n3 = np.bincount(grams.of_triple, np.concatenate(n), len(self.triples)).astype(np.int64)
        self.n2 = _pair_counts(self.pairs, self.triples >> 32, self.n3)
        self.contexts, at = np.unique(np.concatenate(context), return_inverse=True)
        self.classes = np.stack([np.bincount(at, row, len(self.contexts)) for row in np.concatenate(classes, axis=1)]).astype(np.int64)

    def answer(self, pairs: np.ndarray, of: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Counts of the asked pairs, their classes as contexts, and counts of the asked triples; 0 for what is not there."""
        at = _places(self.pairs, pairs)
        triple = np.where(at[of] < len(self.pairs), at[of] << 32 | a, -1)
        n2, n3 = np.append(self.n2, 0)[at], np.append(self.n3, 0)[_places(self.triples, triple)]
        classes = np.append(self.classes, np.zeros((4, 1), np.int64), axis=1)[:, _places(self.contexts, pairs)]
        return np.concatenate([n2, classes.reshape(-1), n3])


def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where ``asked`` values are among ascending ones; their number for those that are not there."""
    at = np.searchsorted(known, asked)
    at[np.append(known, 0)[at] != asked] = len(known)
    return at


class Model:
    """``words(word, number, n, total, once, twice, more)`` and ``counted``, blocks of triples with their counts, as stored tables.

    A word has its count, and as a context the total of the pairs' counts and how many of
    these are 1, 2 and more; ``special`` holds the same of the unknown word, the start and
    the end.  ``discounts`` are those of words, pairs and triples.
    """

    def __init__(self, words: DataFrame, counted: DataFrame, n_words: int, special: np.ndarray, discounts: list[np.ndarray], total: int, spare: float, unknown_share: float):
        self.words, self.counted, self.n_words, self.special = words, counted, n_words, special
        self.discounts, self.total, self.spare, self.unknown_share = discounts, total, spare, unknown_share

    def blocks(self, buckets: int) -> DataFrame:
        """Triples and contexts, dealt to so many buckets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for *numbers, n in arrow_rows(batch, "b", "c", "per", "a", "n"):
                    pairs, of, a = _unpacked(*numbers)
                    n = unpack_numbers(n, "<u8").astype(np.int64)
                    grams = Grams(pairs[of], a)  # ascending and distinct already, so in the order of ``n``
                    rows = [(k, False, *data, pack_numbers(n[triples], "<u8")) for k, _, triples, data in grams.packed(buckets)]
                    context = Grams(a << 32 | pairs[of] >> 32, np.empty(0, np.int64))
                    classes = _classes(context.of_pair, n, len(context.pairs))
                    rows += [(k, True, *data, pack_numbers(classes[:, some].reshape(-1), "<u8")) for k, some, _, data in context.packed(buckets)]
                    yield from _batch(BLOCK, rows).to_batches()

        return self.counted.mapInArrow(run, BLOCK)

    @cached_property
    def _small(self) -> tuple[np.ndarray, Part]:
        """Figures of all words and counts of all n-grams, to look at a small model."""
        figures = np.zeros((5, self.n_words + FIRST), np.int64)
        figures[:, :FIRST] = self.special
        for number, *row in self.words.select(*WORD_FIGURES).collect():
            figures[:, number] = row
        return figures, Part([r.asDict() for r in self.blocks(1).collect()])

    @property
    def word_p(self) -> np.ndarray:
        return _share(self._small[0][0], self.total, self.discounts[0]) + self.spare

    @property
    def word_rest(self) -> np.ndarray:
        return _rest(self._small[0][1:], self.discounts[1])

    @property
    def figures(self) -> DataFrame:
        """``(key, a, g)`` of a small model: probability of an n-gram, and for pairs the share left when the pair is the context."""
        words, part = self._small
        whole = np.append(part.classes, np.zeros((4, 1), np.int64), axis=1)
        pair = part.pairs[part.triples >> 32]
        a, b, c = part.triples & LOW, pair >> 32, pair & LOW
        rows = list(zip(key_of(a, b, c).tolist(), _share(part.n3, whole[0, _places(part.contexts, a << 32 | b)], self.discounts[2]).tolist(), [1.0] * len(a)))
        every = np.union1d(part.pairs, part.contexts)
        b, c = every >> 32, every & LOW
        p = _share(np.append(part.n2, 0)[_places(part.pairs, every)], words[1, b], self.discounts[1])
        g = _rest(whole[:, _places(part.contexts, every)], self.discounts[2])
        rows += zip(key_of(PAIR, b, c).tolist(), p.tolist(), g.tolist())
        return self.words.sparkSession.createDataFrame(rows, "key long, a double, g double")


def fit(sample: DataFrame) -> Model:
    """The model of ``sample(text)``; words seen once stand for unknown ones."""
    spark = session(sample.sparkSession)
    nobody = sample.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    with noted_scratch() as used:
        chunks = stored(_coded(nobody, counted=True), "kn-chunks")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in arrow_rows(batch, "words", "counts"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(unpack_numbers(counts).astype(np.int64))], ["word", "n"])

    with noted_scratch() as more_used:
        counted = stored(chunks.mapInArrow(occurrences, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "kn-counts")
        # Words are numbered through, frequent ones first: by their place in the part that a task wrote, and the sizes of the parts before.
        place = F.monotonically_increasing_id()
        ordered = counted.filter("n > 1").orderBy(F.desc("n"), "word").select("word", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
        placed = stored(ordered, "kn-places")
    tokens, once = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    begin, n_words = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row for each task
        begin, n_words = [*begin, (part, n_words + FIRST)], n_words + n
    if n_words >= 1 << 31:
        raise ValueError("more than two milliards of words")
    begin = spark.createDataFrame(begin, "part long, begin long")
    words = placed.join(F.broadcast(begin), "part").select("word", (F.col("place") + F.col("begin")).alias("number"))
    buckets = 1 + int(tokens) // (BUCKET_BYTES // 8)

    def triples(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        numbers = _joined(right.to_pylist(), row["words"], 1)[0]
        a, b, c, _ = trigram_keys(numbers[unpack_numbers(row["codes"])], np.array(row["lengths"], np.int64))
        grams = Grams(b << 32 | c, a)
        n = np.bincount(grams.of_triple)
        return _batch(BLOCK, [(k, False, *data, pack_numbers(n[some], "<u8")) for k, _, some, data in grams.packed(buckets)])

    def summed(blocks: pa.Table) -> pa.Table:
        part = Part(blocks.to_pylist())
        grams = Grams(part.pairs[part.triples >> 32], part.triples & LOW)
        (_, _, _, data), = grams.packed(1)
        much = lambda n: [int((n == k).sum()) for k in range(1, 5)]
        return pa.table({**{c: [x] for c, x in zip(("b", "c", "per", "a", "n"), (*data, pack_numbers(part.n3, "<u8")))}, "pairs": [much(part.n2)], "triples": [much(part.n3)]})

    dealt = chunks.groupBy("chunk").cogroup(_found_words(chunks, words, ["number"], buckets).groupBy("to")).applyInArrow(triples, BLOCK)
    blocks = stored(dealt.groupBy("bucket").applyInArrow(summed, "b binary, c binary, per binary, a binary, n binary, pairs array<long>, triples array<long>"), "kn-triples")

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *numbers, n in arrow_rows(batch, "b", "c", "per", "a", "n"):
                pairs, of, _ = _unpacked(*numbers)
                n2 = _pair_counts(pairs, of, unpack_numbers(n, "<u8").astype(np.int64))
                number, at = np.unique(np.concatenate([pairs & LOW, pairs >> 32]), return_inverse=True)
                as_last, as_context = np.split(at, 2)
                columns = [np.bincount(as_last, minlength=len(number)), *_classes(as_context, n2, len(number))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in [number, *columns]], WORD_FIGURES)

    figures = blocks.mapInArrow(of_words, ", ".join(f"{c} long" for c in WORD_FIGURES)).groupBy("number").agg(*[F.sum(c).alias(c) for c in WORD_FIGURES[1:]])
    figures = stored(figures, "kn-word-figures")
    special = np.zeros((5, FIRST), np.int64)
    for number, *row in figures.filter(F.col("number") < FIRST).select(*WORD_FIGURES).collect():
        special[:, number] = row
    sums = lambda c: [x or 0 for x in blocks.agg(*[F.sum(F.col(c)[k]) for k in range(4)]).first()]
    ones = dict.fromkeys(range(1, 5), 0) | {r[0]: r[1] for r in figures.filter("n BETWEEN 1 AND 4").groupBy("n").count().collect()}
    discounts = [_discounts([ones[k] for k in range(1, 5)]), _discounts(sums("pairs")), _discounts(sums("triples"))]
    total, taken = figures.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.get(F.lit(discounts[0].tolist()), F.least("n", F.lit(3)).cast("int"))), F.lit(0.0))).first()
    # What the words leave is for all of them; no word is a start.
    spare = max(0.0, 1 - (total - taken) / max(total, 1)) / max(1, n_words + FIRST - 1)
    words = stored(words.join(figures, "number", "left").na.fill(0, WORD_FIGURES[1:]), "kn-words")
    drop_scratch(spark, used + more_used, words)
    return Model(words, blocks, n_words, special, discounts, total, spare, 1.0 / (1 + once))


def _buckets(docs: DataFrame) -> int:
    return 1 + int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES


def score(docs: DataFrame, model: Model, buckets: int | None = None) -> DataFrame:
    """``(doc_id, lang, n_tokens, log_p)`` of every whole text of ``docs(doc_id, text, lang)``; counts are dealt to so many buckets, or as many as the text needs."""
    session(docs.sparkSession)
    special, (d1, d2, d3), total, spare, unknown_share = model.special, model.discounts, model.total, model.spare, model.unknown_share
    buckets = buckets or _buckets(docs)
    # Dealt once: all uses of the chunks read the same shuffle, so columns must not be pruned below it.
    chunks = _coded(docs).repartition("chunk")
    words = _found_words(chunks, model.words, WORD_FIGURES, buckets)

    def grams_of(row: dict, numbers: np.ndarray) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
        two, one, last, owner = trigram_keys(numbers[unpack_numbers(row["codes"])], np.array(row["lengths"], np.int64))
        return Grams(np.append(one << 32 | last, START << 32 | START), two), one, last, owner

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = grams_of(row, _joined(right.to_pylist(), row["words"], len(WORD_FIGURES))[0])[0]
        return _batch(ASKED, [(k, row["chunk"], *data) for k, _, _, data in grams.packed(buckets)])

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _batch(FOUND, [])
        part = Part(right.to_pylist())
        return _batch(FOUND, [(r["to"], r["bucket"], pack_numbers(part.answer(*_unpacked(r["b"], r["c"], r["per"], r["a"])), "<u8")) for r in left.to_pylist()])

    asked = chunks.groupBy("chunk").cogroup(words.groupBy("to")).applyInArrow(ask, ASKED)
    found = asked.groupBy("bucket").cogroup(model.blocks(buckets).groupBy("bucket")).applyInArrow(find, FOUND)
    answers = words.withColumn("words", F.lit(True)).unionAll(found.withColumn("words", F.lit(False)))

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        row, answers = left.to_pylist()[0], right.to_pylist()
        figures = _joined([r for r in answers if r["words"]], row["words"], len(WORD_FIGURES))
        grams, one, last, owner = grams_of(row, figures[0])
        by_pair, by_triple, parts = grams.dealt(buckets)
        of_pair, n3 = np.zeros((5, len(by_pair)), np.int64), np.zeros(len(by_triple), np.int64)
        got = {r["bucket"]: r["found"] for r in answers if not r["words"]}
        for bucket, some, more in parts:
            values, size = unpack_numbers(got[bucket], "<u8").astype(np.int64), 5 * (some.stop - some.start)
            of_pair[:, by_pair[some]], n3[by_triple[more]] = values[:size].reshape(5, -1), values[size:]
        # A triple's context is the pair that ends one token earlier.
        sizes = np.array(row["lengths"], np.int64) + 1
        pair, start = grams.of_pair[:-1], grams.of_pair[-1]
        context = np.append(start, pair[:-1])
        context[np.cumsum(sizes)[:-1]] = start
        number, first = np.unique(np.concatenate([np.arange(FIRST), figures[0]]), return_index=True)
        n1, *classes = np.concatenate([special, figures[1:]], axis=1)[:, first]
        classes = np.stack(classes)
        g2, p1, g3 = _rest(classes, d2), _share(n1, total, d1) + spare, _rest(of_pair[1:], d3)
        log_p = np.zeros(len(sizes))
        for begin in range(0, len(last), PART_TOKENS):
            at = slice(begin, begin + PART_TOKENS)
            before, word = np.searchsorted(number, one[at]), np.searchsorted(number, last[at])
            shorter = _share(of_pair[0][pair[at]], classes[0][before], d2) + g2[before] * p1[word]
            whole = _share(n3[grams.of_triple[at]], of_pair[1][context[at]], d3) + g3[context[at]] * shorter
            # An unknown word has its share of the unknown class at every order.
            whole *= np.where(last[at] == UNKNOWN, unknown_share, 1.0)
            log_p += np.bincount(owner[at], weights=np.log(np.maximum(whole, 1e-300)), minlength=len(sizes))
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "n_tokens": pa.array(sizes), "log_p": pa.array(log_p)})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(rate, SCORED)


def _score_in_parts(docs: DataFrame, model: Model) -> DataFrame:
    """The stored scores of all documents, one part after another, so that what is shuffled for one is gone before the next."""
    buckets = _buckets(docs)
    of = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(PARTS))
    parts = [docs.filter(of == k) for k in range(PARTS)] if buckets > 1 else [docs]
    parts = [stored(score(part, model, buckets), "kn-scored") for part in parts]
    return reduce(DataFrame.unionAll, parts)


def rate_documents(docs: DataFrame, trusted: DataFrame, per_lang: int | None = PER_LANG, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """``(doc_id, lang, n_tokens, perplexity, threshold, kept)`` of each row of ``docs(doc_id, text, lang, ...)``.

    ``trusted(doc_id)`` names trusted documents.  The model learns from one half (by a
    hash) of them: from all with ``per_lang`` None, else from at most ``per_lang`` of each
    language, those with the smallest values of another hash.  The other half is never
    learned from.  A language's threshold is ``slack`` times the ``quantile`` of the
    perplexity of all its trusted documents that were not learned from; a language without
    any has that of its learned ones, one without trusted documents that of all languages.
    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case and one end, so null and
    empty texts have one.  A row without a language belongs to a group of its own.
    Without trusted text nothing is rejected and threshold is null.
    """
    spark = session(docs.sparkSession)
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = docs.filter("text IS NOT NULL").select("doc_id", "lang").join(ids, "doc_id", "left_semi").distinct()
    half = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)
    if per_lang is not None:
        half = smallest_of(half, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_lang)
    chosen = stored(half.select("doc_id").distinct(), "kn-chosen")
    sample = docs.join(chosen, "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]).select("text")
    with noted_scratch() as made, shuffles_removed(spark):
        scored = _score_in_parts(docs, fit(sample))
    drop_scratch(spark, made, scored)
    scored = scored.withColumn("log_ppl", -F.col("log_p") / F.col("n_tokens")).withColumn("perplexity", F.exp("log_ppl"))
    unseen = scored.join(ids, "doc_id", "left_semi").join(chosen.withColumn("fitted", F.lit(True)), "doc_id", "left")
    unseen = unseen.select(F.coalesce("lang", F.lit("")).alias("group"), "log_ppl", F.coalesce("fitted", F.lit(False)).alias("fitted"))
    cut = lambda: F.percentile_approx("log_ppl", quantile, 100_000)
    fresh = unseen.filter("NOT fitted").groupBy("group").agg(cut().alias("fresh"))
    seen = unseen.groupBy("group").agg(cut().alias("seen"))
    limits = seen.join(fresh, "group", "left").select("group", F.coalesce("fresh", "seen").alias("limit"))
    overall = unseen.agg(cut()).first()[0]
    limits = spark.createDataFrame(limits.collect(), "group string, limit double")  # a row for each language
    limit = F.coalesce("limit", F.lit(overall).cast("double")) + math.log(slack)
    return scored.withColumn("group", F.coalesce("lang", F.lit(""))).join(F.broadcast(limits), "group", "left").select(
        "doc_id", "lang", "n_tokens", "perplexity", F.exp(limit).alias("threshold"), F.coalesce(F.col("log_ppl") <= limit, F.lit(True)).alias("kept"),
    )


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """Documents that the labels call good."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


@query("op7_quality")
def quality(spark, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under the model of trusted ones, and who passes."""
    return rate_documents(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir), per_lang=None)
