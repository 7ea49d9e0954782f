"""Vector codes by product quantisation, with dual-tree Lloyd rounds in integers.

Vectors become integers and are cut into equal parts, each with a codebook of its own.
In a round, the parts of some thousand vectors stand in a tree of halves, and so do the
entries of the codebook.  Distance bounds between the boxes of two nodes rule entry nodes
out for a whole node of parts; a node that only one entry is left for is assigned at once,
and its stored sum goes to that entry.  Leaves that stay uncertain compare their parts
with the entries that are left.  All bounds, sums and distances are integers, so the
result does not hang on the order or place of any work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import session, stored, table
from .registry import query

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 8192  # vectors that share a tree
LEAF = 32  # parts of a leaf
LIMIT = 1 << 24  # larger integers could overflow a distance or a node's sum
SUMS = "part int, entry int, n long, total array<long>"


def halves(n: int, least: int) -> list[np.ndarray]:
    """Edges of the nodes of each level: all ``n`` rows, their halves, and so on down to about ``least`` rows."""
    out = [np.array([0, n])]
    while n > least << (len(out) - 1):
        level = len(out)
        out.append((np.arange((1 << level) + 1) * n) >> level)
    return out


class Tree:
    """Integer points in a tree of halves: order, and boxes and sums of the nodes of each level.

    Every level halves each node at the middle of its widest dimension.  Points may stand
    in this order already (``ordered``).
    """

    def __init__(self, points: np.ndarray, leaf: int, ordered: bool = False):
        self.edges = halves(len(points), leaf)
        order = np.arange(len(points))
        if not ordered:
            for edges in self.edges[:-1]:
                place = points[order]
                wide = (np.maximum.reduceat(place, edges[:-1]) - np.minimum.reduceat(place, edges[:-1])).argmax(1)
                node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                order = order[np.lexsort((place[np.arange(len(place)), wide[node]], node))]
        self.order, self.points = order, points[order]
        # Nodes of no rows are only among the lowest ones of an entry tree.
        self.size = [np.diff(e) for e in self.edges]
        self.low, self.high = [], []
        for edges, size in zip(self.edges, self.size):
            at = np.minimum(edges[:-1], len(points) - 1)
            self.low.append(np.minimum.reduceat(self.points, at))
            self.high.append(np.maximum.reduceat(self.points, at))
        self.depth = len(self.edges) - 1

    def sums(self, level: int) -> np.ndarray:
        """The stored sum of each node of a level."""
        if not hasattr(self, "_total"):
            self._total = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, 0)])
        edges = self.edges[level]
        return self._total[edges[1:]] - self._total[edges[:-1]]


@dataclass
class Assigned:
    """Whole nodes of parts with their entry, and single parts with theirs, in the tree's order."""

    nodes: list[tuple[int, np.ndarray, np.ndarray]]  # level, nodes, entries
    rows: np.ndarray
    entries: np.ndarray

    def each(self, tree: Tree) -> np.ndarray:
        """The entry of every part in the tree's order."""
        out = np.full(len(tree.points), -1, np.int64)
        out[self.rows] = self.entries
        for level, node, entry in self.nodes:
            begin, size = tree.edges[level][node], tree.size[level][node]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            out[at] = np.repeat(entry, size)
        return out


class Book:
    """A codebook as a tree; of equal entries only the first is in it, as it wins every tie."""

    def __init__(self, entries: np.ndarray):
        _, first = np.unique(entries, axis=0, return_index=True)
        self.first = np.sort(first)
        self.entries = entries
        self.tree = Tree(entries[self.first], 1)
        self.number = self.first[self.tree.order]  # of the tree's rows


def _box_bounds(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance between points of two boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    far = np.maximum(high_a - low_b, high_b - low_a)
    return (gap * gap).sum(1), (far * far).sum(1)


def assign(tree: Tree, book: Book) -> Assigned:
    """The nearest entry (ties: the lowest number) of every part of the tree."""
    other = book.tree
    nodes: list[tuple[int, np.ndarray, np.ndarray]] = []
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level, below = 0, 0
    bound = np.full(1, np.iinfo(np.int64).max)  # no part of a node is farther from its entry
    while True:
        near, far = _box_bounds(tree.low[level][p], tree.high[level][p], other.low[below][q], other.high[below][q])
        np.minimum.at(bound, p, far)
        keep = near <= bound[p]
        p, q = p[keep], q[keep]
        # A node with one entry left is assigned whole.
        left = np.bincount(p, weights=other.size[below][q], minlength=len(bound)).astype(np.int64)
        sure = left[p] == 1
        if sure.any():
            nodes.append((level, p[sure], book.number[other.edges[below][q[sure]]]))
            p, q = p[~sure], q[~sure]
        if level == tree.depth and below == other.depth or not len(p):
            break
        if level < tree.depth:
            p, q, level = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([q, q]), level + 1
            bound = np.repeat(bound, 2)
        if below < other.depth:
            p, q, below = np.concatenate([p, p]), np.concatenate([2 * q, 2 * q + 1]), below + 1
            there = other.size[below][q] > 0
            p, q = p[there], q[there]
    rows, entries = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(p):
        number = book.number[other.edges[below][q]]
        by = np.lexsort((number, p))
        p, number = p[by], number[by]
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        edges = tree.edges[level]
        for leaf, few in zip(p[cut].tolist(), np.split(number, cut[1:])):
            own = tree.points[edges[leaf] : edges[leaf + 1]]
            away = own[:, None, :] - book.entries[few][None, :, :]
            rows.append(np.arange(edges[leaf], edges[leaf + 1]))
            entries.append(few[np.einsum("ijk,ijk->ij", away, away).argmin(1)])  # the first of equal ones is the lowest
    return Assigned(nodes, np.concatenate(rows), np.concatenate(entries))


def part_sums(tree: Tree, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry got, and their sum."""
    found = assign(tree, book)
    n, total = np.zeros(len(book.entries), np.int64), np.zeros(book.entries.shape, np.int64)
    for level, node, entry in found.nodes:
        np.add.at(n, entry, tree.size[level][node])
        np.add.at(total, entry, tree.sums(level)[node])
    np.add.at(n, found.entries, 1)
    np.add.at(total, found.entries, tree.points[found.rows])
    return n, total


def _usable(vector: str) -> Column:
    """Vectors that are known and hold nothing but finite numbers, one at least."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # not for NaN, which is the largest
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _integers(batch: pa.RecordBatch, vector: str, dims: int, scale: int) -> np.ndarray:
    """The vectors of a batch as rows of integers."""
    flat = batch.column(batch.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(scale * flat.astype(np.float64))
    if len(whole) and np.abs(whole).max() >= LIMIT:
        raise ValueError(f"components times {scale} must be below {LIMIT}")
    return whole.astype(np.int64).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


@dataclass
class Codebooks:
    """Trained codebooks: ``entries[part, entry, position]`` integers, and how vectors are cut."""

    entries: np.ndarray
    scale: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def train(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks of all usable vectors after ``rounds`` Lloyd rounds; None if there is no usable vector with an id.

    A vector is usable if it and all its components are known and finite and it is as
    long as that of the smallest id.  Each part's codebook starts as that part of the
    vectors of the smallest ids (rows that repeat an id in the order of their vectors;
    all rows, if fewer); rows without an id take part in the rounds only.  An entry
    becomes the floor of its parts' mean, an unused one stays.  A task sends on one sum
    for each entry, however many vectors it has.
    """
    spark = session(vectors.sparkSession)
    rows = vectors.filter(_usable(vector)).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    smallest = lambda known: known.filter("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(entries).collect()  # noqa: E731  a codebook's worth
    first = smallest(rows)
    if not first:
        return None
    dims = len(first[0].vector)
    rows = rows.filter(F.size("vector") == dims)
    if any(len(r.vector) != dims for r in first):
        first = smallest(rows)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    start = np.floor(scale * np.array([r.vector for r in first])).astype(np.int64)
    if np.abs(start).max() >= LIMIT:
        raise ValueError(f"components times {scale} must be below {LIMIT}")
    book = start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK):
            whole = _integers(block, "vector", dims, scale).reshape(-1, parts, dims // parts)
            for k in range(parts):
                tree = Tree(np.ascontiguousarray(whole[:, k]), LEAF)
                width = "<i2" if np.abs(tree.points).max() < 1 << 15 else "<i4"
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([width]), pa.array([tree.points.astype(width).tobytes()], pa.binary())], ["part", "width", "points"])

    # The trees are grown once; a row holds one in its order, from which boxes and sums follow.
    trees = stored(rows.select("vector").mapInArrow(grow, "part int, width string, points binary"), "pq-trees")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(book)  # parts * entries short vectors

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = [Book(e) for e in shared.value]
            n, total = np.zeros(shared.value.shape[:2], np.int64), np.zeros(shared.value.shape, np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    k = row["part"]
                    points = np.frombuffer(row["points"], row["width"]).reshape(-1, dims // parts).astype(np.int64)
                    got, added = part_sums(Tree(points, LEAF, ordered=True), books[k])
                    n[k] += got
                    total[k] += added
            k, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(n[k, e]), pa.array(total[k, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
            )

        of = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dims // parts)]
        grown = trees.mapInArrow(sums, SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), *of).collect()  # a row for each entry
        book = book.copy()
        for part, entry, n, *total in grown:
            book[part, entry] = [s // n for s in total]
    return Codebooks(book, scale)


def encode(vectors: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """Usable rows of ``vectors`` with ``code`` (two hex digits an entry number, in part order) and ``error``, the squared distance.

    Columns of these names are replaced, all others stay; rows that cannot be used go.
    Without codebooks no row can.
    """
    session(vectors.sparkSession)
    kept = vectors.drop("code", "error")
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL("code string, error long").fields])
    if books is None:
        return kept.filter("false").select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    spark, dims = vectors.sparkSession, books.dims
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Book(e) for e in shared.value.entries]
        digits = 2 if len(books[0].entries) <= 256 else 4
        for block in _blocks(batches, BLOCK):
            whole = _integers(block, vector, dims, shared.value.scale).reshape(block.num_rows, len(books), -1)
            codes, error = np.zeros((block.num_rows, len(books)), np.int64), np.zeros(block.num_rows, np.int64)
            for k, book in enumerate(books):
                tree = Tree(np.ascontiguousarray(whole[:, k]), LEAF)
                codes[tree.order, k] = assign(tree, book).each(tree)
                away = whole[:, k] - book.entries[codes[:, k]]
                error += (away * away).sum(1)
            text = codes.astype(f">u{digits // 2}").tobytes().hex()
            wide = digits * len(books)
            made = pa.array([text[i : i + wide] for i in range(0, len(text), wide)], pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns, made, pa.array(error)], schema.names)

    return kept.filter(_usable(vector) & (F.size(vector) == dims)).mapInArrow(run, schema)


def _sql() -> str:
    """Plain Lloyd rounds over all pairs of parts and entries; every distance is a sum of sixteen squares."""
    width = 64 // PARTS
    cols = [f"x{i}" for i in range(width)]
    apart = " + ".join(f"(p.{c} - b.{c}) * (p.{c} - b.{c})" for c in cols)
    pick = lambda near, book: f"{near} AS (SELECT p.vec_id, p.part, min(({apart}) * {ENTRIES} + b.entry) AS best FROM p JOIN {book} b USING (part) GROUP BY p.vec_id, p.part)"
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS part, " + ", ".join(f"e[{k * width + i + 1}] AS x{i}" for i in range(width)) + " FROM v" for k in range(PARTS)) + ")",
        f"b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY p.vec_id) - 1 AS entry, {', '.join(cols)} FROM p JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))",
    ]
    floor = lambda c: f"(sum(p.{c}) - (((sum(p.{c}) % count(*)) + count(*)) % count(*))) // count(*)"
    for r in range(ROUNDS):
        steps += [
            pick(f"n{r}", f"b{r}"),
            f"m{r} AS (SELECT part, best % {ENTRIES} AS entry, {', '.join(f'{floor(c)} AS {c}' for c in cols)} FROM p JOIN n{r} USING (vec_id, part) GROUP BY 1, 2)",
            f"b{r + 1} AS (SELECT part, entry, {', '.join(f'CAST(coalesce(m.{c}, b.{c}) AS BIGINT) AS {c}' for c in cols)} FROM b{r} b LEFT JOIN m{r} m USING (part, entry))",
        ]
    last = f"b{ROUNDS}"
    joined = " || ',' || ".join(cols)
    steps += [
        pick("n", last),
        f"c AS (SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM n GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg({joined}, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h"


@query("op11_codebooks", _sql())
def codebooks(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with the error of each row and summed over its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(rows)
    coded = stored(encode(rows, books).select("vec_id", "label", "code", "error"), "pq-codes")
    of_label = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "pq-labels")
    joined = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")))  # broadcast only if Spark finds the stored sums small
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
