import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm.codebooks import Book, Tree, assign, encode, part_sums, train

VECTORS = "vec_id long, embedding array<float>, label int"


def made_rows(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dims))
    rows = [(i, (centres[i % 5] + rng.normal(0, spread * (i % 3) / 3, dims)).astype(np.float32).tolist(), i % 4 if i % 7 else None) for i in range(n)]
    return rows


def brute_lloyd(rows, parts, entries, rounds, scale):
    """Plain Lloyd rounds over usable rows of the smallest id's length."""
    ok = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    first = sorted((r for r in ok if r[0] is not None), key=lambda r: (r[0], r[1]))
    dims = len(first[0][1])
    ok, first = [r for r in ok if len(r[1]) == dims], [r for r in first if len(r[1]) == dims][:entries]
    whole = lambda v: [math.floor(scale * float(np.float32(x))) for x in v]
    width = dims // parts
    books = [[whole(r[1])[k * width : (k + 1) * width] for r in first] for k in range(parts)]
    cut = [[whole(r[1])[k * width : (k + 1) * width] for r in ok] for k in range(parts)]
    nearest = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            got = {}
            for x in cut[k]:
                got.setdefault(nearest(books[k], x)[1], []).append(x)
            books[k] = [[sum(c) // len(got[i]) for c in zip(*got[i])] if i in got else e for i, e in enumerate(books[k])]
    out = []
    for n, r in enumerate(ok):
        best = [nearest(books[k], cut[k][n]) for k in range(parts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    return out, ",".join(str(c) for b in books for e in b for c in e)


@pytest.mark.parametrize("n, entries, seed", [(1, 1, 0), (31, 7, 1), (500, 64, 2), (3000, 256, 3)])
def test_assignment_equals_brute_force(n, entries, seed):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.integers(-40, 40, (n // 2, 4)), rng.integers(-3, 3, (n - n // 2, 4))])
    book = np.concatenate([rng.integers(-40, 40, (entries - entries // 2, 4)), rng.integers(-3, 3, (entries // 2, 4))])  # with equal entries and ties
    away = ((points[:, None] - book[None]) ** 2).sum(2)
    tree = Tree(points, 8)
    entry = assign(tree, Book(book)).each(tree)
    assert (entry == away.argmin(1)[tree.order]).all()
    count, total = part_sums(tree, Book(book))
    for e in range(entries):
        mine = points[away.argmin(1) == e]
        assert count[e] == len(mine) and (total[e] == mine.sum(0)).all()


def test_whole_nodes_are_assigned_by_their_sums():
    points = np.concatenate([np.random.default_rng(5).integers(0, 10, (400, 4)) + 1000 * k for k in range(8)])
    tree = Tree(points, 16)
    found = assign(tree, Book(np.array([[1000 * k] * 4 for k in range(8)])))
    assert len(found.rows) == 0 and sum(len(n) for _, n, _ in found.nodes) < 40


@pytest.mark.parametrize("entries, rounds", [(16, 4), (256, 2)])
def test_training_and_codes_equal_brute_force(spark, entries, rounds):
    odd = [
        (-1, None, 1), (-2, [1.0, None, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0], 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, 2), (-5, [], 2),
        (None, [0.5] * 8, 1), (3, [0.25] * 8, None), (3, [0.25] * 8, None), (700, [0.1] * 9, 3), (701, [-0.0005] * 8, 3),
    ]
    rows = made_rows(400, 8, 1) + odd + [(900 + i, [0.3] * 8, 1) for i in range(300)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).withColumn("error", F.lit("x")).repartition(5)
    books = train(df, entries=entries, rounds=rounds)
    want, text = brute_lloyd(rows, 4, entries, rounds, 1024)
    assert books.sha256() == hashlib.sha256(text.encode()).hexdigest()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in encode(df, books).collect()), key=key) == sorted(want, key=key)


def test_no_usable_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, [1.0] * 4, 1)], VECTORS)
    assert train(df) is None and train(df.limit(0)) is None
    coded = encode(df, None)
    assert coded.columns == ["vec_id", "embedding", "label", "code", "error"] and coded.collect() == []


def test_parts_must_be_equal(spark):
    with pytest.raises(ValueError, match="equal parts"):
        train(spark.createDataFrame([(1, [1.0] * 6, 1)], VECTORS))
