import random

import pytest
from pyspark.sql import functions as F

from tallymart.llm.repeats import cut_words, repeated_spans, without_repeats


def brute(rows, size):
    """Words covered by windows whose first equal one lies in another document or ends before."""
    first, windows = {}, []
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        w = t.encode().lower().split()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            d, p = first.setdefault(key, (i, s))
            if d != i or s - p >= size:
                windows.append((i, s, d))
    spans = []
    for i, s, d in sorted(windows):
        if spans and spans[-1][0] == i and s <= spans[-1][2]:
            spans[-1][2] = s + size
            spans[-1][3] = min(spans[-1][3], d)
        else:
            spans.append([i, s, s + size, d])
    return sorted((i, s, e - s, d) for i, s, e, d in spans)


def spans(df, **options):
    return sorted((r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in repeated_spans(df, **options).collect())


def test_spans_match_brute_force(docs, corpus):
    got = spans(docs.withColumn("key", F.lit(1)).withColumn("piece", F.lit("x")))
    assert got == brute(corpus, 50) and len(got) > 10


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_random_place_and_length(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{rng.randrange(9)}" for _ in range(n)] for k, n in enumerate((19, 20, 21, 35, 60))]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 12))] + rng.choice(passages)[rng.randint(0, 3):]
        rows.append((i, " ".join(text + rng.choice([[], ["same"] * 70]))))
    got = spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=20)
    assert got == brute(rows, 20) and got


def test_copies_of_a_document_that_holds_an_earlier_passage(spark):
    run = lambda k, n: [f"{k}{i}" for i in range(n)]
    passage = run("p", 55)
    both = " ".join(run("c", 80) + passage + run("d", 80))
    rows = [(1, " ".join(run("a", 60) + passage + run("b", 60))), (20, both), (30, both), (40, both + " z")]
    got = spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows, 50) and (30, 0, 215, 1) in got


def test_passages_are_cut_once(spark, docs, corpus):
    out = without_repeats(docs.withColumn("extra", F.lit("x"))).collect()
    by_id = {r.doc_id: r for r in out}
    before = {r[0]: r for r in corpus}
    left = [(i, r.text) for i, r in by_id.items()]
    assert brute(left, 70) == []
    assert all(by_id[i].text == before[i][1] and by_id[i].n_chars == before[i][4] for i in (9001, 9002, 9003, 9005, 9007))
    touched = {x[0] for x in brute(corpus, 50)}
    for i in touched & set(by_id):
        assert by_id[i].n_chars == len(by_id[i].text) and by_id[i].extra == "x"
    assert all(by_id[i].text == before[i][1] for i in set(before) - touched)


def test_cutting_keeps_the_other_bytes():
    assert cut_words("A  b\nc é\td ", [(1, 2)]) == "A  é\td "
    assert cut_words(" x y", [(0, 2)]) == " "


def test_an_id_with_different_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, a), (1, b), (2, a), (2, b + " z")]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r.text for r in out]
    assert sum(t.startswith("a0 ") for t in texts) == 1 and sum("b0 " in t for t in texts) == 1


@pytest.mark.parametrize("others", [[], [(99, "x"), (99, "y")]])
def test_order_does_not_hang_on_other_ids(spark, others):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{i} {passage}") for i in range(1, 6)] + others
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_number", F.col("doc_id") + 70).withColumn("_cuts", F.lit("x")).repartition(4)
    out = {r.doc_id: (r.text, r["_number"], r["_cuts"]) for r in without_repeats(df).collect() if r.doc_id < 9}
    assert out == {i: (f"{i} {passage}" if i == 1 else f"{i} ", i + 70, "x") for i in range(1, 6)}


def test_a_frequent_passage_is_dealt_to_many_tasks(spark, monkeypatch):
    from tallymart.llm import repeats

    monkeypatch.setattr(repeats, "HOT_RATE", 1)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(i % 7)] + passage + [f"b{i}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = repeats._frequent(df, 50, 20)
    assert len(frequent) and repeats._suffixes(df, 50, 20, frequent).filter("salt > 0").select("salt").distinct().count() > 20
    assert spans(df) == brute(rows, 50)


def test_empty_table(nothing):
    assert repeated_spans(nothing).collect() == [] and without_repeats(nothing).collect() == []
