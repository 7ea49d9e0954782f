"""Language-model scores by a probabilistic suffix tree.

Symbols are all words with three or more training occurrences, an end of text, and two
classes: words seen once or twice, and unknown ones, for which words seen once stand in
learning.  A word's probability is that of its symbol in the current state times its share
of the class.  States are contexts of up to three symbols that occur ``LEAST`` times in the
training texts, however many these are.  Contexts of one symbol are kept; a longer one is
kept if its figures, without the occurrence itself, foretell its next symbols better than
those of its longest kept suffix by more than a state costs.  Kept distributions are
smoothed towards the suffix.  A token is scored in the state of the longest suffix kept.

The tree is never in one place.  All positions with the same two symbols before them meet
in one of many buckets, so that a context of two or three symbols, its next symbols and the
tokens to be scored in it are together; the counts of single pairs come from shards of
pairs.  What tasks share is one figure for each distinct number of occurrences of a word.

``grow`` and ``score_bounded`` are a smaller tree that every task holds: its symbols are the
most frequent words and classes of the others by their counts, and the contexts of a level
are as many as the fourth root of the training tokens allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import coded_chunks, joined_chunks, learned_counts, pack_numbers, unpack_numbers
from .common import drop_scratch, mix64, noted_scratch, session, shuffles_removed, stored, table
from .language_id import remainder
from .registry import query

TOP_WORDS, DEPTH, LEAST_CONTEXTS, PULL = 400, 3, 512, 50.0
GROWTH = 11  # contexts a level can have for each unit of the fourth root of the training tokens
BANDS = 48
# Symbols: 0 the end, 1 to TOP_WORDS frequent words, then an unknown word, words seen once, twice, and by doubled counts.
UNKNOWN, ONCE, TWICE, MORE = TOP_WORDS + 1, TOP_WORDS + 2, TOP_WORDS + 3, TOP_WORDS + 4
SYMBOLS = MORE + BANDS
CODED = "doc_ids array<long>, flags array<boolean>, lengths array<int>, symbols binary, known array<long>, base array<double>, share array<double>"


def count_symbol(c: np.ndarray) -> np.ndarray:
    """Symbol of a word with ``c`` training occurrences that is not among the frequent ones."""
    band = np.ceil(np.log2(np.maximum(c, 3) / 2)).astype(np.int64) - 1  # 3 and 4, 5 to 8, 9 to 16 ...
    return np.where(c == 0, UNKNOWN, np.where(c == 1, ONCE, np.where(c == 2, TWICE, MORE + band)))


def training_symbols() -> np.ndarray:
    """For learning, a word seen once stands for the unknown ones: without its own occurrence it would be one."""
    out = np.arange(SYMBOLS)
    out[ONCE] = UNKNOWN
    return out


def scoring_symbols() -> np.ndarray:
    """For scoring, words seen once or twice are one class."""
    out = np.arange(SYMBOLS)
    out[ONCE] = TWICE
    return out


@dataclass
class Tree:
    """Kept contexts by length, as sorted codes with the number of their state; state 0 is the empty context."""

    codes: list[np.ndarray]
    states: list[np.ndarray]
    log_p: np.ndarray  # states by symbols, base 10

    def state_of(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """State before each symbol; ``place`` is its position in its text."""
        state = np.zeros(len(symbols), np.int64)
        code, scale = np.zeros(len(symbols), np.int64), 1
        for depth, (codes, states) in enumerate(zip(self.codes, self.states), start=1):
            before = np.zeros(len(symbols), np.int64)
            before[depth:] = symbols[: max(0, len(symbols) - depth)]
            code, scale = code + before * scale, scale * SYMBOLS
            if len(codes):
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = (codes[at] == code) & (place >= depth)
                state[hit] = states[at[hit]]
        return state


def _context_codes(symbols: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``depth`` symbols before them, and the code of those (the nearest has the lowest digit)."""
    at = np.flatnonzero(place >= depth)
    code = np.zeros(len(at), np.int64)
    for j in range(depth, 0, -1):
        code = code * SYMBOLS + symbols[at - j]
    return at, code


def _texts(row, kind: str = "<u2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts of a chunk with their ends, each one's text and place."""
    lengths = np.array(row["lengths"], np.int64) + 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return unpack_numbers(row["symbols"], kind).astype(np.int64), owner, place


def _counts(coded: DataFrame, contexts: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Next-symbol counts of the given contexts in the training texts, summed in tasks and then by Spark."""
    wanted = coded.sparkSession.sparkContext.broadcast(contexts)  # at most as many codes as a level can have contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, fold = wanted.value, training_symbols()
        total = np.zeros(len(contexts) * SYMBOLS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                symbols, owner, place = _texts(row)
                symbols = fold[symbols]
                at, code = _context_codes(symbols, place, depth)
                learn = np.array(row["flags"], bool)[owner[at]]
                at, code = at[learn], code[learn]
                where = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
                hit = contexts[where] == code
                total += np.bincount(where[hit] * SYMBOLS + symbols[at[hit]], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["cell", "n"])

    rows = coded.select("flags", "lengths", "symbols").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = {int(c): np.zeros(SYMBOLS) for c in contexts}
    for cell, n in rows:
        out[int(contexts[cell // SYMBOLS])][cell % SYMBOLS] = n
    return out


def context_limit(tokens: float) -> float:
    """How many contexts a level can have at most: a context needs that share of the tokens."""
    return max(LEAST_CONTEXTS, GROWTH * tokens**0.25)


def grow(coded: DataFrame, depth: int = DEPTH, least_share: float | None = None, pull: float = PULL) -> Tree:
    """Grow the tree level by level; a level has at most ``1 / least_share`` contexts, which reach the driver."""
    root = _counts(coded, np.zeros(1, np.int64), 0)[0]
    tokens = root.sum()
    least_share = least_share or 1 / context_limit(tokens)
    real = scoring_symbols() == np.arange(SYMBOLS)  # symbols that scoring knows
    p_root = np.where(real, (root + 0.5) / (tokens + 0.5 * real.sum()), 0.0)
    log = lambda p: np.log10(np.maximum(p, 1e-300)).astype(np.float32)
    table_rows, codes, states = [log(p_root)], [], []
    counts: dict[int, np.ndarray] = {0: root}
    smooth: dict[tuple[int, int], np.ndarray] = {(0, 0): p_root}
    for d in range(1, depth + 1):
        # A longer context is a context of the level before and a symbol that follows it often enough.
        frequent = [
            before * SYMBOLS + int(s) for before, row in counts.items() for s in np.flatnonzero(row >= max(2.0, least_share * tokens))
        ] if d > 1 else [int(s) for s in np.flatnonzero(root >= max(2.0, least_share * tokens))]
        contexts = np.array(sorted(c for c in frequent if c % SYMBOLS != 0), np.int64)  # nothing follows an end
        if not len(contexts):
            break
        counts = _counts(coded, contexts, d)
        kept: list[tuple[int, int]] = []
        for code, row in counts.items():
            total = row.sum()
            # The longest proper suffix that has a distribution: drop the farthest symbol.
            parent = next(smooth[(k, code % SYMBOLS**k)] for k in range(d - 1, -1, -1) if (k, code % SYMBOLS**k) in smooth)
            seen = row > 0
            p = (row + pull * parent) / (total + pull)
            gain = float((row[seen] * np.log(row[seen] / total / np.maximum(parent[seen], 1e-300))).sum())
            if total and gain > 0.5 * np.log(max(tokens, 2)) * max(1, int(seen.sum()) - 1):
                smooth[(d, code)] = p
                kept.append((code, len(table_rows)))
                table_rows.append(log(p))
        codes.append(np.array([c for c, _ in kept], np.int64))
        states.append(np.array([s for _, s in kept], np.int64))
    return Tree(codes, states, np.stack(table_rows))


def score_bounded(docs: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """What ``score_documents`` gives, with a score by the smaller tree that every task holds."""
    spark = session(docs.sparkSession)
    learn = F.coalesce("learn", F.lit(False))
    chunks = stored(coded_chunks(docs.select("doc_id", "text", learn.alias("learn"), learn.alias("flag"))), "tree-chunks")
    counts = stored(learned_counts(chunks), "tree-counts")
    ends = chunks.agg(F.coalesce(F.sum(F.size(F.filter("flags", lambda x: x))), F.lit(0))).first()[0]
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, types = int(n_words + ends), int(distinct + (ends > 0))
    top = counts.orderBy(F.desc("c"), "word").limit(top_words).select("word", "c").collect()
    top_counts = np.array([0, *(r.c for r in top)], np.int64)
    rank = spark.createDataFrame([(bytes(r.word), i) for i, r in enumerate(top, start=1)], "word binary, symbol int")
    # One figure for each word: its count, or for a frequent word its symbol below zero.
    figures = counts.join(F.broadcast(rank), "word", "left").select("word", F.coalesce(-F.col("symbol"), "c").alias("figure"))
    # Training occurrences in each class of words; a bounded number of classes.
    band = F.when(F.col("figure") <= 2, F.lit(0)).otherwise(F.ceil(F.log2(F.col("figure") / 2)))
    mass = np.ones(SYMBOLS)
    for b, total in figures.filter("figure > 0").groupBy(band.cast("int").alias("b")).agg(F.sum("figure").alias("n")).collect():
        mass[TWICE if b == 0 else MORE + b - 1] = total
    log_base = np.log10(tokens + types + 1)

    def code(row: dict, got: dict[str, np.ndarray]) -> pa.RecordBatch:
        figure = np.zeros(row["n_words"], np.int64)
        figure[got["number"]] = got["figure"]
        frequent = np.maximum(-figure, 0)
        c = np.where(frequent > 0, top_counts[frequent], figure)
        symbol = np.where(frequent > 0, frequent, count_symbol(c))
        fold = scoring_symbols()
        # A word's share of its class; frequent words and the unknown one are alone in theirs.
        shared = symbol > UNKNOWN
        share = np.where(shared, np.log10(np.maximum(c, 1) / mass[fold[symbol]]), 0.0)
        lengths, words = np.array(row["lengths"], np.int64), unpack_numbers(row["codes"]).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = lambda x: np.bincount(owner, weights=x[words], minlength=len(lengths))
        with_ends = np.zeros(len(words) + len(lengths), np.int64)
        inside = np.ones(len(with_ends), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        with_ends[inside] = symbol[words]
        base = sums(np.log10(c + 1.0)) + np.log10(ends + 1.0) - (lengths + 1) * log_base
        values = [
            [row["doc_ids"]], [row["flags"]], [row["lengths"]], [pack_numbers(with_ends, "<u2")],
            [(sums((c > 0).astype(float)) + (ends > 0)).astype(np.int64)], [base], [sums(share)],
        ]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["doc_ids", "flags", "lengths", "symbols", "known", "base", "share"])

    coded = stored(joined_chunks(chunks, figures, code, CODED, ["figure"]), "tree-coded")
    shared_tree = spark.sparkContext.broadcast(grow(coded))  # states by symbols, bounded by the parameters

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, fold, learning = shared_tree.value, scoring_symbols(), training_symbols()
        for batch in batches:
            for row in batch.to_pylist():
                symbols, owner, place = _texts(row)
                # Contexts are read as in learning, the symbol itself as scoring knows it.
                state = tree.state_of(learning[symbols], place)
                got = np.bincount(owner, weights=tree.log_p[state, fold[symbols]].astype(np.float64), minlength=len(row["lengths"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["flags"], pa.bool_()), pa.array(np.array(row["lengths"], np.int64) + 1), pa.array(row["known"], pa.int64()),
                     pa.array(row["base"], pa.float64()), pa.array(got + np.array(row["share"]))],
                    ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"],
                )

    made = coded.mapInArrow(score, "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return made.withColumn("train_tokens", F.lit(tokens).cast("long"))


LEAST = 20  # training occurrences of a context
PAIRS_BUCKET = 1 << 20  # tokens of a bucket, about
# Symbols of the whole tree: the end, which as a context means that there is none, then classes, then words, frequent ones first.
END, UNSEEN, RARE, SEEN_ONCE, FIRST = range(5)
LEARNS, SCORES = 1, 2  # what a position is for, in the low bits of its owner
LOW = (1 << 32) - 1
WHOLE = "chunk long, doc_ids array<long>, flags array<boolean>, lengths array<int>, symbols binary, known array<long>, base array<double>, share array<double>"
GRAMS = "bucket int, chunk long, b binary, c binary, per binary, d binary, a binary, owner binary"
ASKED = "shard int, to int, c binary, d binary, n binary"
FOUND = "to int, shard int, n binary"
SUMS = "chunk long, owner binary, sums binary"
SCORED = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Root:
    """Training occurrences of every symbol: of the classes, and of words by where each count begins among their numbers."""

    classes: np.ndarray
    begins: np.ndarray
    counts: np.ndarray
    kinds: int  # symbols but for that of words seen once, which is no symbol in scoring

    @property
    def tokens(self) -> int:
        return int(self.classes.sum() + (np.diff(np.append(self.begins, self.kinds + 1)) * self.counts).sum())

    def of(self, symbols: np.ndarray) -> np.ndarray:
        out = self.classes[np.minimum(symbols, FIRST - 1)]
        word = symbols >= FIRST
        out[word] = self.counts[np.searchsorted(self.begins, symbols[word], "right") - 1]
        return out


def _numbered(counts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """``(word, c, number)`` with 0 for words seen once or twice, where each count's numbers begin, the counts, and how many symbols there are."""
    # Numbers by the place in the part that a task wrote, and the sizes of the parts before.
    place = F.monotonically_increasing_id()
    columns = "word", "c", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    placed = stored(counts.filter("c > 2").orderBy(F.desc("c"), "word").select(*columns), "tree-places")
    begin, end = [], FIRST
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row for each task
        begin, end = [*begin, (part, end)], end + n
    if end > LOW:
        raise ValueError("more than four milliards of words")
    steps = sorted(((c, n) for c, n in counts.filter("c > 2").groupBy("c").count().collect()), reverse=True)  # at most the root of twice the tokens
    many = np.array([n for _, n in steps], np.int64)
    begin = counts.sparkSession.createDataFrame(begin, "part long, begin long")
    words = placed.join(F.broadcast(begin), "part").select("word", "c", (F.col("place") + F.col("begin")).alias("number"))
    rare = counts.filter("c <= 2").select("word", "c", F.lit(0).cast("long").alias("number"))
    return words.unionAll(rare), FIRST + np.cumsum(many) - many, np.array([c for c, _ in steps], np.int64), end - 1


def _flat(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _dealt(keys: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of ``values`` whose keys belong to it, ascending by value."""
    order = np.argsort(values, kind="stable")
    bucket = (mix64(keys[order].astype(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    here, first = np.unique(bucket[by_bucket], return_index=True)
    for k, some in zip(here.tolist(), np.split(order[by_bucket], first[1:])):
        yield k, some


def _positions(row: dict, buckets: int) -> list[tuple]:
    """Every token of a chunk with the three symbols before it, by buckets of the nearest two."""
    symbols, owner, place = _texts(row, "<u4")
    learned = np.array(row["flags"], bool)[owner]
    once = symbols == SEEN_ONCE
    context = np.where(once, UNSEEN, symbols)
    before = []
    for depth in (1, 2, 3):
        before.append(np.where(place >= depth, np.roll(context, depth), END))
    bits = np.where(learned & ~once, LEARNS | SCORES, SCORES)
    # A word seen once is learned from as an unknown one and scored as a rare one.
    more = np.flatnonzero(learned & once)
    at = np.append(np.arange(len(symbols)), more)
    c, b, a = (x[at] for x in before)
    d = np.append(np.where(once, RARE, symbols), np.full(len(more), UNSEEN))
    mark = (owner[at] << 2) | np.append(bits, np.full(len(more), LEARNS))
    pair = b << 32 | c
    keys = np.where(b == END, c << 32 | d, pair)  # no context of two symbols, so nothing that has to meet
    out = []
    for bucket, some in _dealt(keys, pair, buckets):
        pairs, per = np.unique(pair[some], return_counts=True)
        out.append((bucket, row["chunk"], *(pack_numbers(x) for x in (pairs >> 32, pairs & LOW, per, d[some], a[some], mark[some]))))
    return out


class Bucket:
    """The positions of one bucket: their pair of symbols before, the symbol before that, their own, and what they are for."""

    def __init__(self, grams: pa.Table):
        rows = sorted(grams.to_pylist(), key=lambda r: r["chunk"])
        per = [unpack_numbers(r["per"]) for r in rows]
        read = lambda c: [unpack_numbers(r[c]).astype(np.int64) for r in rows]
        pair = [np.repeat(b << 32 | c, n) for b, c, n in zip(read("b"), read("c"), per)]
        self.chunks, self.sizes = [r["chunk"] for r in rows], [len(p) for p in pair]
        self.pair, self.d, self.a = (np.concatenate(x) for x in (pair, read("d"), read("a")))
        mark = np.concatenate(read("owner"))
        self.owner, self.learns, self.scores = mark >> 2, mark & LEARNS > 0, mark & SCORES > 0
        self.cells, self.of_cell = np.unique((self.pair & LOW) << 32 | self.d, return_inverse=True)

    def asked(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """The shards of the distinct last pairs, each with the places of its pairs."""
        return _dealt(self.cells, self.cells, buckets)


def _state(key: np.ndarray, d: np.ndarray, learns: np.ndarray, suffix: np.ndarray, least: int, pull: float, cost: float) -> np.ndarray:
    """Probability of each ``d`` in its context ``key``, which is that of the ``suffix`` where the context is not kept."""
    contexts, of = np.unique(key, return_inverse=True)
    total = np.bincount(of, learns, len(contexts))
    cells, first, of_cell = np.unique(of << 32 | d, return_index=True, return_inverse=True)
    n, p, whole = np.bincount(of_cell, learns, len(cells)), suffix[first], total[cells >> 32]
    seen = n > 0
    gain = np.zeros(len(cells))
    gain[seen] = n[seen] * np.log((n[seen] - 1 + pull * p[seen]) / (whole[seen] - 1 + pull) / p[seen])
    kept = (total >= least) & (np.bincount(cells >> 32, gain, len(contexts)) > cost)
    return np.where(kept[cells >> 32], (n + pull * p) / (whole + pull), p)[of_cell]


def token_probabilities(bucket: Bucket, n_last: np.ndarray, root: Root, least: int = LEAST, pull: float = PULL) -> np.ndarray:
    """Probability of each position's symbol in its state; ``n_last`` are the training counts of the last pairs."""
    tokens = root.tokens
    last, d = bucket.cells >> 32, bucket.cells & LOW
    p = (root.of(d) + 0.5) / (tokens + 0.5 * root.kinds)
    total = np.where(last == END, 0, root.of(last))
    p = np.where(total >= least, (n_last + pull * p) / (total + pull), p)[bucket.of_cell]
    cost = 0.5 * np.log(max(tokens, 2))
    pairs, of = np.unique(bucket.pair, return_inverse=True)
    often = (np.bincount(of, bucket.learns, len(pairs)) >= least) & (pairs >> 32 != END)
    at = np.flatnonzero(often[of])  # all others have no longer context
    if len(at):
        p[at] = _state(of[at], bucket.d[at], bucket.learns[at], p[at], least, pull, cost)
        at = at[bucket.a[at] != END]
        if len(at):
            p[at] = _state(of[at] << 32 | bucket.a[at], bucket.d[at], bucket.learns[at], p[at], least, pull, cost)
    return p


def score_documents(docs: DataFrame, least: int = LEAST, pull: float = PULL) -> DataFrame:
    """Scores of ``docs(doc_id, text, learn)``; the model learns from rows with ``learn``.

    Returns ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score`` for each
    row.  Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case and one end;
    a null text is empty and has the end only.  ``base_score`` adds up
    ``log10((c + 1) / (N + V + 1))``, ``score`` the tree's.  Without training rows every
    word is unknown.  Rows that repeat an id are scored each; an empty table gives none.
    """
    spark = session(docs.sparkSession)
    learn = F.coalesce("learn", F.lit(False))
    with noted_scratch() as used, shuffles_removed(spark):
        chunks = stored(coded_chunks(docs.select("doc_id", "text", learn.alias("learn"), learn.alias("flag"))), "tree-chunks")
        counts = stored(learned_counts(chunks), "tree-counts")
        figures, begins, steps, last = _numbered(counts)
    n_flags = F.size(F.filter("flags", lambda x: x))
    n_places = F.size("lengths") + F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    ends, places = chunks.agg(F.coalesce(F.sum(n_flags), F.lit(0)), F.coalesce(F.sum(n_places), F.lit(0))).first()
    n_words, distinct, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    tokens, types = int(n_words + ends), int(distinct + (ends > 0))
    buckets = 1 + int(places) // PAIRS_BUCKET
    log_base, log_rare = np.log10(tokens + types + 1), np.log10(max(1, once + 2 * twice))

    def code(row: dict, got: dict[str, np.ndarray]) -> pa.RecordBatch:
        number, c = np.zeros(row["n_words"], np.int64), np.zeros(row["n_words"], np.int64)
        number[got["number"]], c[got["number"]] = got["symbol"], got["c"]
        symbol = np.where(number > 0, number, np.array([UNSEEN, SEEN_ONCE, RARE])[np.minimum(c, 2)])
        # A rare word's share of its class; all others are alone.
        share = np.where((c == 1) | (c == 2), np.log10(np.maximum(c, 1)) - log_rare, 0.0)
        lengths, words = np.array(row["lengths"], np.int64), unpack_numbers(row["codes"]).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = lambda x: np.bincount(owner, weights=x[words], minlength=len(lengths))
        with_ends = np.insert(symbol[words], np.cumsum(lengths), END)
        base = sums(np.log10(c + 1.0)) + np.log10(ends + 1.0) - (lengths + 1) * log_base
        values = [
            [row["chunk"]], [row["doc_ids"]], [row["flags"]], [row["lengths"]], [pack_numbers(with_ends)],
            [(sums((c > 0).astype(float)) + (ends > 0)).astype(np.int64)], [base], [sums(share)],
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [f.split()[0] for f in WHOLE.split(", ")])

    with shuffles_removed(spark):
        coded = stored(joined_chunks(chunks, figures.withColumnRenamed("number", "symbol"), code, WHOLE, ["symbol", "c"]), "tree-coded")
    drop_scratch(spark, used, coded)
    shared = spark.sparkContext.broadcast((np.array([ends, once, 2 * twice, 0], np.int64), begins, steps, last))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _flat(GRAMS, _positions(row, buckets)).to_batches()

    def ask(grams: pa.Table) -> pa.Table:
        bucket, to = Bucket(grams), grams.column("bucket")[0].as_py()
        n = np.bincount(bucket.of_cell, bucket.learns, len(bucket.cells)).astype(np.int64)
        return _flat(ASKED, [(k, to, *(pack_numbers(x) for x in (bucket.cells[some] >> 32, bucket.cells[some] & LOW, n[some]))) for k, some in bucket.asked(buckets)])

    def count(asks: pa.Table) -> pa.Table:
        rows = asks.to_pylist()
        read = lambda c: [unpack_numbers(r[c]).astype(np.int64) for r in rows]
        cells = [c << 32 | d for c, d in zip(read("c"), read("d"))]
        known, of = np.unique(np.concatenate(cells), return_inverse=True)
        total = np.bincount(of, np.concatenate(read("n")), len(known)).astype(np.int64)
        parts = np.split(total[of], np.cumsum([len(c) for c in cells])[:-1])
        return _flat(FOUND, [(r["to"], r["shard"], pack_numbers(n, "<u8")) for r, n in zip(rows, parts)])

    def rate(grams: pa.Table, answers: pa.Table) -> pa.Table:
        bucket, found = Bucket(grams), dict(zip(answers.column("shard").to_pylist(), answers.column("n").to_pylist()))
        n_last = np.zeros(len(bucket.cells), np.int64)
        for k, some in bucket.asked(buckets):
            n_last[some] = unpack_numbers(found[k], "<u8").astype(np.int64)
        log_p = np.log10(token_probabilities(bucket, n_last, Root(*shared.value), least, pull))
        out, begin = [], 0
        for chunk, size in zip(bucket.chunks, bucket.sizes):
            at = begin + np.flatnonzero(bucket.scores[begin : begin + size])
            begin += size
            owner, of = np.unique(bucket.owner[at], return_inverse=True)
            out.append((chunk, pack_numbers(owner), np.bincount(of, log_p[at], len(owner)).astype(np.float32).tobytes()))
        return _flat(SUMS, out)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        score = np.array(row["share"])
        for r in sorted(right.to_pylist(), key=lambda r: r["owner"]):
            score[unpack_numbers(r["owner"])] += np.frombuffer(r["sums"], np.float32)
        values = row["doc_ids"], row["flags"], np.array(row["lengths"], np.int64) + 1, row["known"], row["base"], score
        kinds = pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
        return pa.table({f.split()[0]: pa.array(v, k) for f, v, k in zip(SCORED.split(", "), values, kinds)})

    # Dealt once: asking and rating read the same shuffle.
    grams = coded.select("chunk", "flags", "lengths", "symbols").mapInArrow(deal, GRAMS).repartition("bucket")
    answers = grams.groupBy("bucket").applyInArrow(ask, ASKED).groupBy("shard").applyInArrow(count, FOUND)
    sums = grams.groupBy("bucket").cogroup(answers.groupBy("to")).applyInArrow(rate, SUMS)
    slim = coded.select("chunk", "doc_ids", "flags", "lengths", "known", "base", "share")
    made = slim.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(add, SCORED)
    return made.withColumn("train_tokens", F.lit(tokens).cast("long"))


@query("op3_suffix_tree")
def suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a tree that learns from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    learn = F.col("doc_id").isNotNull() & ~held
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learn")))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
