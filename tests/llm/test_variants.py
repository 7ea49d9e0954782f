import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallymart.llm.variants import count_runs, near_words, variant_forms

WORDS = "word string, n long"


def one_edit(a, b):
    """Plain: one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, factor=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def brute_runs(rows, drop_every, least):
    out = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if drop_every and h % drop_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= least:
                    out[run] += 1
            run = ""
    return dict(out)


def made_words(letters, number, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 5, 10, 25, 60, 400]) for _ in range(number)}
    return words | {"": 3, "日本語": 2, "日本": 10, "aéb": 1, "aèb": 5}


def test_near_words_equal_brute_force_in_small_and_large_tiles(spark):
    words = made_words("abcé", 700, 1)
    df = spark.createDataFrame(list(words.items()), WORDS).repartition(5)
    want = sorted((a, words[a], b, words[b]) for a in words for b in words if one_edit(a, b))
    assert len(want) > 2000
    for block in (7, 2048):  # tiles cut into block pairs, and whole ones
        assert sorted(map(tuple, near_words(df, block).collect())) == want


def test_forms_equal_brute_force(spark):
    words = made_words("ab", 300, 2) | {"kanzel": 1, "kanzen": 5, "kanten": 25, "karten": 125, "warten": 625}
    df = spark.createDataFrame([*words.items(), (None, 4)], WORDS).withColumn("form", F.lit("clash")).withColumn("root", F.lit(1))
    rows = variant_forms(df, block=50)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = {tuple(r) for r in rows.collect()}
    assert found == brute_forms(words) and {r[2] for r in found if r[0] == "kanzel"} == {"warten"}


def test_repeated_words_add_up_and_ties_take_the_smaller(spark):
    df = spark.createDataFrame([("bat", 1), ("cat", 3), ("cat", 2), ("rat", 5)], WORDS)
    assert {tuple(r) for r in variant_forms(df).collect()} == {("bat", "cat", "cat", 1, 2, 5), ("cat", None, "cat", 5, 2, None), ("rat", None, "rat", 5, 2, None)}


def test_runs_equal_brute_force(spark, docs, corpus, nothing):
    for drop, least in ((None, 1), (3, 4), (199, 6)):
        got = {r.word: r.n for r in count_runs(docs, drop_every=drop, min_length=least).collect()}
        assert got == brute_runs([r[:2] for r in corpus], drop, least)
    assert count_runs(nothing, drop_every=3).count() == 0
    assert variant_forms(count_runs(nothing)).count() == 0


def test_texts_of_other_letters(spark):
    rows = [(1, "ŐÉ×÷ß Éa日bĀc x­Y"), (None, "abcdefg " * 50), (2, "ABCDEFG-abcdefg" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("x"))
    assert {r.word: r.n for r in count_runs(df, drop_every=2).collect()} == brute_runs(rows, 2, 1)
