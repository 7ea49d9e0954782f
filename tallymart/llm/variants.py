"""Spelling variants by dense prefix-suffix tiling.

Two words are one edit apart if their common prefix and their common suffix together
reach the longer length minus one.  One of the two then covers half of that, so words are
dealt to tiles by the longer length of a pair and half of a word, from its front or its
back.  In a tile, blocks of words stand as padded matrices of code points, and every pair
of a block pair is compared at once, position by position.  Tiles with very many words
are cut into block pairs of bounded size that go to tasks of their own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, session, stored, table
from .registry import query

BLOCK = 2048  # words of a tile's side
COUNTED = 300_000  # words that a task counts before it hands them on
NEAR = "word string, n long, other string, other_n long"

# Bytes of Latin-1 text: letters A-Z become lower case, other letters stay, all else becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def count_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int | None = None, min_length: int = 1) -> DataFrame:
    """``(word, n)``: occurrences of letter runs of at least ``min_length`` code points over all whole texts.

    With ``drop_every``, a run of a document loses one code point if that number divides
    the crc32 of ``<doc_id>:<run>``: the one at the crc32 modulo the run's length.  A null
    text has no run; a null id is written as nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return made

        for batch in batches:
            for number, t in arrow_rows(batch, "doc_id", "text"):
                # A run never grows, so shorter ones need no look.
                found = Counter(r for r in letter_runs(t) if len(r) >= min_length) if t else {}
                if not drop_every:
                    counts.update(found)
                    continue
                begin = zlib.crc32(b":" if number is None else b"%d:" % number)
                for r, n in found.items():
                    h = zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), begin)
                    if not h % drop_every:
                        at = h % len(r)
                        r = r[:at] + r[at + 1 :]
                        if len(r) < min_length or not r:
                            continue
                    counts[r] += n
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _padded(words: list[str], width: int) -> np.ndarray:
    """Code points of words, a row each, filled up with 0."""
    flat = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, "<u4").reshape(len(words), width)


def common_start(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of ``a`` with every row of ``b``, fill included."""
    alike, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T, b.T):
        alike &= x[:, None] == y[None, :]
        if not alike.any():
            break
        out += alike
    return out


def near_in_tile(words: list[str], side: np.ndarray, front: bool, longest: int, rows: int = 256) -> list[tuple[int, int]]:
    """Pairs of one tile that are one edit apart and whose longer word has ``longest`` code points.

    ``side`` tells which block a word is of: a tile of two blocks compares one with the
    other, a tile of one block all its words.  Pairs that have half of the length in
    common at their front are left to the tiles by fronts.
    """
    one, two = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    forth, back = _padded(words, longest), _padded([w[::-1] for w in words], longest)
    length = np.fromiter(map(len, words), np.int32, len(words))
    out = []
    for at in range(0, len(one), rows):
        a = one[at : at + rows]
        shorter = np.minimum(length[a][:, None], length[two][None, :])
        start = np.minimum(common_start(forth[a], forth[two]), shorter)
        end = np.minimum(common_start(back[a], back[two]), shorter)
        ok = (start + end >= longest - 1) & (np.maximum(length[a][:, None], length[two][None, :]) == longest)
        ok &= (start >= longest // 2) if front else (start < longest // 2)
        x, y = np.nonzero(ok)
        pairs = np.stack([a[x], two[y]], 1)
        out += (pairs[pairs[:, 0] != pairs[:, 1]] if side.min() != side.max() else pairs[pairs[:, 0] < pairs[:, 1]]).tolist()
    return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, n, other, other_n)`` of distinct ``words(word, n)``, both ways, that differ by one inserted, deleted or replaced code point."""
    session(words.sparkSession)
    words = words.filter("word IS NOT NULL").select("word", "n")
    half = lambda m: F.floor(m / 2).cast("int")
    length = F.char_length("word")
    # As the longer word of a pair, or as the one that is shorter by one.
    keys = F.array(*[
        F.struct(m.alias("longest"), F.lit(front).alias("front"), (F.left("word", half(m)) if front else F.right("word", half(m))).alias("part"))
        for m in (length, length + 1) for front in (True, False)
    ])
    keyed = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*").withColumn("tile", F.xxhash64("longest", "front", "part"))
    # Tiles of very many words; the table is small, and Spark joins it by its size.
    large = stored(keyed.groupBy("tile").agg(F.count("*").alias("size")).filter(F.col("size") > block), "variant-tiles")
    parts = keyed.join(large, "tile", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"))
    tiles = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "tile", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "longest", "front", "part", "own", "word", "n"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """All tiles of some sorted rows that hold every tile whole."""
            names = [rows.column(c).to_numpy() for c in ("tile", "i", "j", "longest", "front")]
            part = rows.column("part").to_pylist()  # keys may share a hash
            edge = np.zeros(rows.num_rows, bool)
            for c in names:
                edge[1:] |= c[1:] != c[:-1]
            edge[1:] |= np.fromiter((a != b for a, b in zip(part[1:], part)), bool, len(part) - 1)
            edge[0] = True
            begins = np.flatnonzero(edge)
            ends = np.append(begins[1:], rows.num_rows)
            several = ends - begins > 1
            word, own = rows.column("word").to_pylist(), rows.column("own").to_numpy()
            a, b = [], []
            for s, e in zip(begins[several].tolist(), ends[several].tolist()):
                side = own[s:e]
                if names[1][s] != names[2][s] and side.min() == side.max():
                    continue  # the other block has no word
                for x, y in near_in_tile(word[s:e], side, bool(names[4][s]), int(names[3][s])):
                    a += [s + x, s + y]
                    b += [s + y, s + x]
            if a:
                left, right = (rows.select(["word", "n"]).take(pa.array(x, pa.int64())) for x in (a, b))
                yield from pa.table([*left.columns, *right.columns], names=["word", "n", "other", "other_n"]).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy() for i in range(3)]
            # Rows up to the last change of tile are whole.
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            if held and [held[-1].column(i)[-1].as_py() for i in range(3)] != [k[0] for k in key]:
                change = np.append([0], change)
            if len(change):
                at = int(change[-1])
                whole = pa.Table.from_batches([*held, batch.slice(0, at)])
                if whole.num_rows:
                    yield from compare(whole)
                held = [batch.slice(at)]
            else:
                held.append(batch)
        if held:
            yield from compare(pa.Table.from_batches(held))

    order = ("tile", "i", "j")
    return tiles.repartition(*order).sortWithinPartitions(*order, "longest", "front", "part").mapInArrow(run, NEAR)


def variant_forms(words: DataFrame, factor: int = 5, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``words(word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if
    that is at least ``factor`` times the word's own, else null.  ``root`` is where a walk
    over forms ends.  Rows that repeat a word are added up; a null word is left out.
    """
    session(words.sparkSession)
    words = stored(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "variant-words")
    best = near_words(words, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    )
    row = stored(
        words.join(best, "word", "left").withColumn("known", -F.col("best.less") >= factor * F.col("n")).select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("known"), F.col("best.form")).alias("form"), F.when(F.col("known"), -F.col("best.less")).alias("form_n"),
        ), "variant-rows",
    )
    # Each round doubles the steps that are walked; a form's n is factor times larger, so walks are short.
    walked = stored(row.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-walk")
    while walked.limit(1).count():
        further = walked.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = stored(walked.join(further, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "variant-walk")
        walked = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            break
    return row.join(walked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_LATIN = "".join(chr(c) for c in range(0xC0, 0x100))
_SINGLE = "".join(chr(c) for c in range(33, 127) if not 97 <= c <= 122 and c not in (39, 92))[: len(_LATIN)]


def _crc_table() -> list[int]:
    """The usual table of the reversed polynomial, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


VARIANT_SQL = f"""
WITH RECURSIVE t AS (SELECT {_crc_table()}::BIGINT[] AS crc),
r AS (
    SELECT doc_id, r, count(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS r
        FROM documents WHERE text IS NOT NULL
    ) GROUP BY ALL
), h AS (
    SELECT r, k, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
            lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END))),
        lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])) AS c
    FROM r, t
), x AS (SELECT r, k, xor(c, 4294967295) AS h FROM h),
e AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, k FROM x
), w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
s AS (SELECT word, n, translate(word, '{_LATIN}', '{_SINGLE}') AS plain FROM w),
p AS (
    SELECT a.word, b.word AS other, a.n, b.n AS other_n FROM s a JOIN s b
    ON length(b.plain) BETWEEN length(a.plain) - 1 AND length(a.plain) + 1 AND levenshtein(a.plain, b.plain) = 1
), o AS (
    SELECT word, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM p
), f AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
    FROM w LEFT JOIN o ON o.word = w.word AND o.k = 1
), walk AS (
    SELECT word, word AS root, form AS next FROM f
    UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""


@query("op13_variants", VARIANT_SQL)
def variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the frequent words of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variant_forms(count_runs(docs, drop_every=199, min_length=6).filter("n >= 5"))
