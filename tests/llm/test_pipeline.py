from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import catalog


def test_stages_one_after_another(spark, docs, sf_dir, corpus):
    rows, ids = docs, {r[0] for r in corpus}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
            out = out.cache()
            now = {r.doc_id for r in out.select("doc_id").collect()}
            assert now <= ids
            ids = now
            rows = out
        seen[name] = out.collect()
    assert not {9001, 9002, 9003, 9004} & {r.doc_id for r in seen["language"]}
    kept = [r.doc_id for r in seen["near_duplicates"]]
    assert len(kept) == len(set(kept)) and not {9007, 9008} <= set(kept)
    tokens = sum(len(r.text.encode().split()) + 1 for r in seen["repeats"])
    assert sum(r.n_tokens for r in seen["packing"]) == tokens
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in whole.collect()) == sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in seen["packing"])


def test_stages_on_no_rows(spark, nothing, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).collect() == []


CLASHING = ["_number", "number", "cuts", "_cuts", "gone", "row", "id", "k", "group", "kept", "component", "n_tokens", "code"]


def test_awkward_rows_and_clashing_columns(spark, corpus, sf_dir):
    """Rows that repeat an id, maps, and columns named like those that the stages make, through all stages."""
    rows = corpus + [(7, corpus[7][1], "en", "s", 1), (7, corpus[8][1] + " more", "en", "s", 1), (9005, None, None, None, None), (None, corpus[3][1], "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    df = df.withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id"))).repartition(3)
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        assert result.columns == df.columns, name
        docs = spark.createDataFrame(result.collect(), result.schema).repartition(3)
        for r in docs.collect():
            own = "none" if r.doc_id is None else str(r.doc_id)
            assert all(r[c] == f"{c}:{own}" for c in CLASHING) and r["a map"] == {"k": r.doc_id}
    ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and len(ids) > 100
    assert corpus_pipeline.run_stages(spark, df, sf_dir).count() >= len(ids)


def test_results_outlive_later_calls_on_other_tables(spark, docs, sf_dir, tmp_path):
    """A result that is not written yet stays readable while the stage works on another table."""
    one = corpus_pipeline.cut_repeats(spark, docs, sf_dir)
    corpus_pipeline.cut_repeats(spark, docs.filter("doc_id < 50"), sf_dir).write.parquet(str(tmp_path / "two"))
    one.write.parquet(str(tmp_path / "one"))
    back = spark.read.parquet(str(tmp_path / "one"))
    mark = back.schema["doc_id"].metadata["stage"]
    assert corpus_pipeline._LEFT[mark]
    corpus_pipeline.pack_sequences(spark, back, sf_dir).count()
    assert not corpus_pipeline._LEFT[mark]  # what it was made from is gone once it comes back


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in catalog.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in catalog.QUERIES and set(catalog.SQL) <= set(catalog.QUERIES)
