"""Language identification, suffix tree, quality and BPE: accuracy, brute force and awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import bpe, language_id, quality, suffix_tree


def learns(i, by, left_out):
    return zlib.crc32(str(i).encode()) % by != left_out


def test_language_of_texts_not_learned_from(docs, corpus):
    known = docs.filter(language_id.remainder(F.col("doc_id"), 3) != 1)
    model = language_id.fit(known.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.predict(docs.withColumn("score", F.lit("x")), model).collect()}
    held = [r for r in corpus if r[0] is not None and r[0] < 200 and not learns(r[0], 3, 1)]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held) > 20
    assert all(got[r[0]].accepted for r in held)
    for i in (9001, 9002, 9003, 9004):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9006].lang_pred in ("en", "fr")


def test_language_without_anything_to_learn(docs, nothing):
    model = language_id.fit(nothing.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"und"}
    assert language_id.predict(nothing, model).collect() == []


def test_language_sample_does_not_hang_on_the_layout(docs):
    rows = docs.select("doc_id", "text", "lang")
    one, two = (language_id.fit(rows.repartition(n), per_lang=20) for n in (1, 5))
    assert np.array_equal(one.table, two.table) and one.threshold == two.threshold


def test_suffix_tree_base_and_gain(docs, corpus):
    learn = language_id.remainder(F.col("doc_id"), 7) != 2
    got = {r.doc_id: r for r in suffix_tree.score_documents(docs.withColumn("c", F.lit(1)).withColumn("learn", learn)).collect()}
    words = {r[0]: (r[1] or "").encode().lower().split() + [None] for r in corpus}
    counts = Counter(w for i, ws in words.items() if i is not None and learns(i, 7, 2) for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(corpus)
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())


def test_suffix_tree_probabilities_add_up_and_use_context(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):  # after "a" comes "b", after "b b" comes "c"
        text = []
        while len(text) < 60:
            text += [["a", "b"], ["b", "b", "c"], [f"r{rng.integers(0, 400)}"]][rng.integers(0, 3)]
        rows.append((i, " ".join(text), i % 5 != 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    scored = suffix_tree.score_documents(df).filter("NOT learned").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > 0.9 * scored[1]
    tree = suffix_tree.Tree([np.array([3]), np.array([], np.int64)], [np.array([1]), np.array([], np.int64)], np.zeros((2, suffix_tree.SYMBOLS)))
    assert tree.state_of(np.array([3, 4, 3, 3]), np.array([0, 1, 2, 0])).tolist() == [0, 1, 0, 0]


def test_suffix_tree_distributions_are_whole(spark, docs):
    from tallymart.llm.chunks import pack_numbers

    symbols = np.array([1, 2, 1, 2, suffix_tree.ONCE, 0] * 50)
    coded = spark.createDataFrame(
        [([1] * 50, [True] * 50, [5] * 50, pack_numbers(symbols, "<u2"), [0], [0.0], [0.0])], suffix_tree.CODED)
    tree = suffix_tree.grow(coded)
    assert np.allclose((10.0 ** tree.log_p.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert sum(map(len, tree.codes)) > 0


def test_suffix_tree_grows_with_the_text():
    limits = [suffix_tree.context_limit(n) for n in (1e3, 4e6, 1e8, 1e10, 1e13)]
    assert limits == sorted(limits) and limits[0] == 512 and limits[-1] > 10_000


def test_suffix_tree_without_training_rows(docs, nothing):
    got = suffix_tree.score_documents(docs.withColumn("learn", F.lit(False))).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(math.isfinite(r.score) for r in got)
    assert suffix_tree.score_documents(nothing.withColumn("learn", F.lit(True))).collect() == []


def test_quality_keeps_prose_and_drops_junk(spark, docs, words, corpus):
    rng = np.random.default_rng(9)
    junk = [(20_000 + i, " ".join("".join(rng.choice(list("%#&$*!?QX"), 6)) for _ in range(80)), "en", "s", 1) for i in range(10)]
    whole = docs.unionByName(spark.createDataFrame(junk, docs.schema)).withColumn("limit", F.lit(1)).withColumn("fitted", F.lit("x"))
    trusted = docs.filter("doc_id < 160 AND doc_id % 2 = 0").select("doc_id")
    got = {r.doc_id: r for r in quality.rate_documents(whole, trusted).collect()}
    assert len(got) == len(corpus) + 10
    assert not any(got[i].kept for i in range(20_000, 20_010))
    clean = [r[0] for r in corpus if r[0] is not None and r[0] < 160]
    assert sum(got[i].kept for i in clean) >= 0.97 * len(clean)
    assert got[9001].n_tokens == 1 and got[None].perplexity > 0


def test_quality_learns_from_five_hundred_documents_of_a_language(spark, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda sample: seen.append(sample.count()) or fit(sample))
    df = spark.createDataFrame([(i, f"some plain words {i % 7}", "en") for i in range(1300)], "doc_id long, text string, lang string")
    assert quality.rate_documents(df, df.select("doc_id")).count() == 1300 and seen == [500]


def test_quality_model_is_a_distribution(spark):
    """Over all words of the vocabulary, the unknown class and the end, every context's shares add up to one."""
    rng = np.random.default_rng(3)
    texts = [(" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 30) if x < 40),) for _ in range(60)]
    model = quality.fit(spark.createDataFrame(texts, "text string"))
    rows = {r.key: (r.a, r.g) for r in model.figures.collect()}
    every = [c for c in range(len(model.word_p)) if c != quality.START]
    assert sum(model.word_p[c] for c in every) == pytest.approx(1, abs=0.05)
    pair = lambda b, c: rows.get(quality.key_of(quality.PAIR, b, c), (0, 1))[0] + model.word_rest[b] * model.word_p[c]
    for a, b in [(quality.START, quality.START), (quality.START, 5), (4, 5), (9, 3)]:
        g = rows.get(quality.key_of(quality.PAIR, a, b), (0, 1))[1]
        total = sum(rows.get(quality.key_of(a, b, c), (0, 1))[0] + g * pair(b, c) for c in every)
        assert total == pytest.approx(1, abs=0.05)


def test_quality_without_trusted_text(docs, nothing):
    got = quality.rate_documents(docs, nothing.select("doc_id")).collect()
    assert all(r.kept and r.threshold is None for r in got)
    assert quality.rate_documents(nothing, docs.select("doc_id")).collect() == []


def test_bpe_equals_the_library(spark, docs, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    theirs = tokenizers.Tokenizer.from_file(path)
    vocabulary = bpe.Vocabulary.load(path)
    odd = ["a" * 500, "ab" * 300 + "É" * 90, "x<|startoftext|><|endoftext|>y <|END|>", "Σίσυφος ΣΑΣ", "½ ² 1234", "  a\x1cb", "é É", "'Ll'D's''t"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(30_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = bpe.encode_texts(rows.withColumn("ids", F.lit(1)), vocabulary, bpe.build_lexicon(spark, rows, vocabulary, top=200)).collect()
    assert len(got) == len(corpus) + len(odd)
    for r in got:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert list(r.ids) == ids and r.decoded == decoded and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["thing", "things", "string", "strings", "ring", "", "rings", "a"])}
    flat = bpe.compile_lexicon(words)
    bpe.save_lexicon(flat, str(tmp_path / "x/words.bin"))
    lexicon = bpe.Lexicon(str(tmp_path / "x/words.bin"))
    numbers = lexicon.numbers(list(words))
    assert sorted(numbers.tolist()) == list(range(len(words)))
    assert [lexicon.ids_of(n).tolist() for n in numbers.tolist()] == list(words.values())
    assert lexicon.numbers([b"thin", b"ringsx", b"zz"]).tolist() == [-1] * 3
    starts = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(flat["final"]) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in starts})
    assert bpe.Lexicon.numbers(lexicon, []).tolist() == []


def test_bpe_merges_side_by_side_as_one_by_one():
    merger = bpe.Merger(bpe.Vocabulary.load(bpe.vocabulary_path()))
    rng = random.Random(8)
    words = [bytes(rng.choice(b"abeinrst\xc3\xa9\xff0.") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 20, 40, 48, 49, 90]))) for _ in range(3000)]
    assert [ids.tolist() for ids in merger.merge_all(words, together=500)] == [merger.merge(w) for w in words] and merger.merge_all([]) == []


def test_bpe_of_no_rows(spark, nothing):
    vocabulary = bpe.Vocabulary.load(bpe.vocabulary_path())
    uri = bpe.build_lexicon(spark, nothing, vocabulary)
    assert bpe.encode_texts(nothing, vocabulary, uri).collect() == []


def test_language_of_a_very_long_text_in_parts():
    letters = language_id.letter_table()
    rng = random.Random(2)
    text = "".join(rng.choice("abcÉß日1. \n ") for _ in range(5000))
    for size in (1, 7, 300):
        parts = list(language_id.parts_of(text, size))
        assert len(parts) > 3
        got = Counter(i for p in parts for i in language_id.subwords(p, letters).tolist())
        assert got == Counter(language_id.subwords(text, letters).tolist())
    assert list(language_id.parts_of("x" * 50, 3)) == ["x" * 50] and list(language_id.parts_of("")) == [""]


def test_language_sample_of_one_language_over_many_partitions(spark):
    from tallymart.llm.common import smallest_of

    df = spark.range(0, 20_000, 1, 50).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    got = {r.doc_id for r in smallest_of(df, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], 40).collect()}
    want = {r.doc_id for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()}
    assert got == want


def test_quality_learns_from_all_trusted_documents_of_the_half(spark, monkeypatch, tmp_path):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda sample: seen.append({r.text for r in sample.collect()}) or fit(sample))
    df = spark.createDataFrame([(i, f"some plain words {i}", "en", "s", 1) for i in range(1300)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    df.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    half = {r.text for r in df.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).collect()}
    assert quality.quality(spark, str(tmp_path)).count() == 1300 and seen == [half] and len(half) > 600
    corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    assert seen == [half, half]


def test_quality_scores_are_the_same_in_many_buckets_and_chunks(spark, docs, monkeypatch):
    sample = docs.filter("doc_id < 100").select("text")
    one = quality.score(docs, quality.fit(sample)).collect()
    monkeypatch.setattr(quality, "BUCKET_BYTES", 4 << 10)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 3 << 10)
    many = quality.score(docs, quality.fit(sample)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id)
    for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
        assert a[:3] == b[:3] and a.log_p == pytest.approx(b.log_p, rel=1e-12)


def test_quality_scores_in_parts_and_leaves_no_shuffled_data(spark, docs, monkeypatch):
    trusted, key = docs.filter("doc_id < 160 AND doc_id % 2 = 0").select("doc_id"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = lambda df: sorted(((r.doc_id or -1, r.n_tokens, round(r.perplexity, 6), round(r.threshold, 6), r.kept) for r in df.collect()))
    one, parts, score, before = rows(quality.rate_documents(docs, trusted)), [], quality.score, spark.conf.get(key, None)
    monkeypatch.setattr(quality, "score", lambda *a: parts.append(spark.conf.get(key)) or score(*a))
    monkeypatch.setattr(quality, "BUCKET_BYTES", 16 << 10)
    assert rows(quality.rate_documents(docs, trusted)) == one
    assert parts == ["true"] * quality.PARTS and spark.conf.get(key, None) == before
