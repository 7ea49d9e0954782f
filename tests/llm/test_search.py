import math

import numpy as np
from pyspark.sql import functions as F

from tallymart.llm.topk_search import top_k


def brute(rows, k, every):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            best[i] = min(best.get(i, q), q)
    out = []
    for i in (i for i in best if i % every == 0):
        score = lambda j: sum(a * b for a, b in zip(best[i], best[j]))
        top = sorted((-score(j), j) for j in best if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(top, 1)]
    return sorted(out)


def test_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # many ties
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.inf] * 6), (903, [math.nan] * 6), (None, [1.0] * 6)]
    rows += [(905, [0.0] * 6), (7, rows[7][1]), (910, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    for size in (64, 5000):
        got = top_k(df, F.col("vec_id") % 5 == 0, block_rows=size, query_rows=20).select("query_id", "rank", "vec_id", "score")
        assert sorted(map(tuple, got.collect())) == brute(rows, 5, 5)


def test_reading_stops_early_on_spread_values(spark):
    rows = [(i, [float(i), float(i % 7)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(df, F.col("vec_id") == 1999, block_rows=10_000).collect()
    assert [r.vec_id for r in got] == [1998, 1997, 1996, 1995, 1994] and max(r.depth for r in got) < 1000


def test_fewer_rows_than_wanted_and_none(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in top_k(df, F.col("vec_id") == 1).collect()] == [(1, 2)]
    assert top_k(df.limit(0), F.col("vec_id") == 1).collect() == []
