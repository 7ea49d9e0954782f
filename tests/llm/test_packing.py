import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallymart.llm.packing import LENGTHS, OVERHEAD, pack, pack_documents, token_count


def plain_pack(sizes, lengths, overhead):
    """The same rules with lists and searches."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, out = [], {}
    for n, i in enumerate(order):
        fits = [b for b in bins if b[0] >= sizes[i]]
        if fits:
            room = min(b[0] for b in fits)
            b = [b for b in bins if b[0] == room]
            b = max(b, key=lambda b: b[3])  # the one that came to this room last
        else:
            rest = [sizes[j] for j in order[n + 1 :]]
            cost = lambda c: (c + overhead) / (sizes[i] + min(c - sizes[i], sum(s for s in rest if s <= c - sizes[i])))
            b = [min((c for c in lengths if c >= sizes[i]), key=lambda c: (cost(c), c)), [], len(bins), 0]
            bins.append(b)
        b[0] -= sizes[i]
        b[1].append(i)
        b[3] = n + 1
        out[i] = b[2]
    return [out[i] for i in range(len(sizes))], [min(c for c in lengths if c >= sum(sizes[i] for i in b[1])) for b in bins]


def test_rules_match_a_plain_version():
    rng = random.Random(6)
    for _ in range(40):
        lengths = rng.choice([(8, 16, 32), (10,), (4, 30)])
        sizes = [rng.randint(1, max(lengths)) for _ in range(rng.randint(0, 60))]
        bins, offsets, final, used = pack(np.array(sizes, np.int64), lengths, 3)
        want, want_final = plain_pack(sizes, lengths, 3)
        assert bins.tolist() == want and final == want_final


def check(rows, lengths, tokens):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r.offset)
        ends = [r.offset + r.n_tokens for r in rs]
        assert [r.offset for r in rs] == [0, *ends[:-1]] and ends[-1] == rs[0].bin_used
        assert rs[0].bin_length == min(c for c in lengths if c >= ends[-1])
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert dict(got) == tokens


def test_every_piece_has_a_place(spark, docs, corpus):
    tokens = defaultdict(int)
    for r in corpus:
        tokens[r[0]] += len((r[1] or "").encode().split()) + 1
    n = token_count(F.col("text"))
    for window in (7, 50_000):
        rows = pack_documents(docs.withColumn("shard", F.lit(1)).withColumn("n", F.lit("x")), n, window=window).collect()
        check(rows, LENGTHS, tokens)
    long = sorted((r.start, r.n_tokens) for r in rows if r.doc_id == 500)
    assert [s for s, _ in long] == list(range(0, 30_001, 4096)) and len(long) == 8
    assert OVERHEAD > 0 and sum({r.bin_id: r.bin_length for r in rows}.values()) < 1.15 * sum(tokens.values())


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, 3)] * 50 + [(2, 0), (3, None)], "doc_id long, n long")
    rows = pack_documents(df, F.col("n"), lengths=(8, 16), window=20).collect()
    check(rows, (8, 16), {1: 150})
    assert pack_documents(df.limit(0), F.col("n")).collect() == []
