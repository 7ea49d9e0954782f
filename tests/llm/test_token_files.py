import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import token_files as tf

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = [*"aAbBzZ09.,;:!?)\"](-'\n\t\r\x0b\x0c\x1c\x85\xa0 ÉßÀ×÷é̊Σςſ日İ\x01\x00<|'sreL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "don't", " the ", "fürchten"]


def plain(texts, end):
    """Ids of whole texts by one call of the library each."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    return [library.encode(t or "", add_special_tokens=False).ids + end for t in texts]


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(6000)] + [None, ""]
    want = [np.array(ids, "<u4").tobytes() for ids in plain(texts, [])]
    for parted, memo in ((True, 500_000), (True, 5), (False, 5)):
        encoder = tf.WordEncoder(PATH, parted, memo)
        assert [x for i in range(0, len(texts), 1000) for x in encoder.encode(texts[i : i + 1000])] == want


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 25])
def test_files_hold_all_documents_in_order(spark, docs, corpus, tmp_path, shard_bytes):
    folder = str(tmp_path / "ids")
    rows = docs.withColumn("n_tokens", F.lit("clash")).withColumn("shard", F.lit(None).cast("int"))
    manifest = tf.write_token_files(rows, PATH, folder, end_id=1, parted=True, shard_bytes=shard_bytes).orderBy("shard").collect()
    assert (len(manifest) > 5) == (shard_bytes == 2000) and sum(m.documents for m in manifest) == len(corpus)
    texts = ordered(corpus)
    want, start = [], 0
    for row, ids in zip(texts, plain([r[1] for r in texts], [1])):
        want.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = tf.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert [m.first_token for m in manifest] == [sum(m.tokens for m in manifest[:i]) for i in range(len(manifest))]
    # Single documents, on the driver and by a job.
    name, named = manifest[0].name, manifest[0].dictionary
    with tf._opened(folder, name, named) as file:
        assert [np.frombuffer(file.ids(i), "<u4").tolist() for i in file.find(None)] == [want[0][4]]
        assert [np.frombuffer(file.ids(i), "<u4").tolist() for i in file.find(0)] == [want[1][4]] and not len(file.find(-5))
    asked = spark.createDataFrame([(9006,), (3,), (3,), (-1,), (None,)], "doc_id long")
    assert sorted(map(tuple, tf.fetch_documents(spark, folder, asked).collect())) == sorted((r[0], r[4]) for r in want if r[0] in (3, 9006))


def test_repeated_ids_equal_rows_and_no_rows(spark, nothing, tmp_path):
    rows = [(7, "same text")] * 50 + [(7, "another one"), (8, None), (None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = tf.write_token_files(df, PATH, str(tmp_path / "a"), end_id=1, parted=True, shard_bytes=100)
    assert manifest.count() > 3  # rows of one id are dealt to several files
    got = tf.read_token_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((d is not None, d or 0, ids) for (d, _), ids in zip(rows, plain([t for _, t in rows], [1])))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))] and [r.doc_id for r in got][:2] == [None, None]
    assert tf.write_token_files(nothing, PATH, str(tmp_path / "b"), parted=True).collect() == []
    assert tf.read_token_files(spark, str(tmp_path / "b")).collect() == []


def test_another_dictionary_is_refused(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    row = tf.write_token_files(docs, PATH, folder, parted=True).first()
    with pytest.raises(ValueError, match="dictionary"):
        tf.TokenFile(folder, row.name, b"other")


def test_query_equals_the_library(spark, sf_dir, corpus):
    texts = ordered(corpus)
    start, want = 0, []
    for row, ids in zip(texts, plain([r[1] for r in texts], [1])):
        want.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tf.token_files(spark, sf_dir).orderBy("start").collect()] == want
