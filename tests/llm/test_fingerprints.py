import hashlib

from pyspark.sql import functions as F

from tallymart.llm.fingerprints import BINS, edited_fingerprints, fingerprint


def test_edited_texts_and_likeness(spark, docs, corpus, shingle_sets):
    got = edited_fingerprints(docs.withColumn("id", F.lit(1)).withColumn("start", F.lit("x"))).collect()
    rows = sorted((r[0], r[1] or "") for r in corpus if r[0] is not None)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(corpus)
    errors = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        assert by_id[i].n_chars == n and by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingle_sets(t, 5), shingle_sets(edited, 5)
        want = len(a & b) / len(a | b) if a | b else 1.0
        errors.append(abs(by_id[i].near_edited - want))
        assert 0 <= by_id[i].near_next <= 1 and len(by_id[i].fingerprint) == (2 * BINS if a else 0)
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.3
    assert by_id[9007].fingerprint == by_id[9008].fingerprint and by_id[9007].near_next == 1.0
    assert by_id[9001].fingerprint == "" and by_id[9001].near_next == 1.0  # the next one is empty too
    assert by_id[None].edited_sha256 == hashlib.sha256(b"no id at all ").hexdigest()


def test_one_row_is_its_own_next_and_repeated_ids(spark):
    one = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    assert edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = [(1, "aaaabbbb"), (1, "ccccdddd"), (2, "zzzz"), (2, "yyyy")]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = ["aaaabbyy", "ccccddyy", "zzza", "yyya"]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(w.encode()).hexdigest() for w in want)


def test_empty_table(nothing):
    assert edited_fingerprints(nothing).collect() == []


def test_no_python_in_the_plan(docs):
    plan = docs.select(fingerprint(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
