import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm.near_duplicates import REGISTERS, estimate, link_documents, set_sketches


def brute(rows, size, groups, shingle_sets):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingle_sets(r[1], size))
    g = groups(sets)
    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if 100 * len(a & b) >= 80 * len(a | b):
                g.join(i, j)
    return {i: g.find(i) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_components_match_brute_force(docs, corpus, groups, shingle_sets, size):
    want = brute(corpus, size, groups, shingle_sets)
    got = link_documents(docs.withColumn("key", F.lit(1)).withColumn("component", F.lit("x")), size).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    sizes = {r[0]: len(shingle_sets(r[1], size)) for r in corpus}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    assert len(set(want.values())) < len(want)


def test_a_chain_and_a_cloud_of_near_copies(spark, groups, shingle_sets):
    """Copies of one text with many edits each: links depend on the pair, and none may be lost."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(int(rng.integers(0, 5))):
            text[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(text)))
    text = [f"c{i}" for i in range(200)]
    for i in range(30):  # each differs a little from the one before, the ends share nothing
        text = text[7:] + [f"d{i}_{j}" for j in range(7)]
        rows.append((1000 + i, " ".join(text)))
    want = brute(rows, 5, groups, shingle_sets)
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {want[i] for i in range(1000, 1030)} == {1000}


def test_rows_that_repeat_an_id_are_one_document(spark, groups, shingle_sets):
    t = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(5, t[0]), (5, t[1]), (7, t[1]), (7, t[2]), (3, t[2]), (8, "else"), (8, "else")]
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
        (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False), (8, 8, True), (8, 8, True)]


def test_empty_table(nothing):
    assert link_documents(nothing).collect() == []


def test_sketches_merge_and_estimates_are_close():
    rng = np.random.default_rng(2)
    a, b, common = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (150, 100, 750))
    one, two = np.concatenate([a, common]), np.concatenate([b, common])
    s = set_sketches([one, two, np.concatenate([a, b, common])])
    assert (np.maximum(s[0], s[1]) == s[2]).all() and s.shape[1] == REGISTERS
    got = estimate(s[:1], s[1:2], np.array([900]), np.array([850]))[0]
    assert abs(got - 0.75) < 0.1


def test_an_id_that_is_not_the_smallest_of_its_class_may_repeat(spark):
    x, y = (" ".join(f"{k}{i}" for i in range(40)) for k in "xy")
    rows = [(3, x), (7, x), (7, y), (8, y), (9, "z")]
    got = link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (7, 3, False), (7, 3, False), (8, 3, False), (9, 9, True)]
