"""Corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every
result as Parquet to the shared folder and hands it, read again, to the next stage.  All
but the last return the columns of ``documents`` as they were, whatever further columns
there are and however they are named.  Rows without an id are never near duplicates, have
no repeats and are rated for their language only.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymart.llm import language_id, near_duplicates, packing, quality, repeats
from tallymart.llm.common import drop_scratch, noted_scratch, scratch_dir, session, table
from tallymart.llm.registry import query


# Scratch folders of each stage's result, by the mark that its id column carries.
_LEFT: dict[str, list[str]] = {}


def _written(spark: SparkSession, docs: DataFrame) -> None:
    """Remove the scratch folders of the result that ``docs`` was written from, but for those that it still reads."""
    mark = docs.schema["doc_id"].metadata.get("stage") if "doc_id" in docs.columns else None
    if mark in _LEFT:
        drop_scratch(spark, _LEFT[mark], docs)


def _stage(work):
    """A stage marks its result; when that comes back from a file, as the next stage's input, what it was made from goes."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _written(session(spark), docs)
        with noted_scratch() as made:
            result = work(spark, docs, sf_dir)
        mark = uuid.uuid4().hex
        _LEFT[mark] = made
        return result.withMetadata("doc_id", {"stage": mark})

    return run_stage


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of the given ids; rows without an id stay."""
    return docs.join(ids, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letter, or a score below the calibrated limit.

    The model learns from the stage's own rows that have a language.  Null and empty
    texts have no letter and go; with no labelled row at all nothing can be learned, and
    all documents stay.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs
    return language_id.predict(docs, model).filter("accepted").select(docs.columns)


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity is over their language's limit; rows without an id stay."""
    rated = quality.rate_documents(docs, quality.trusted_ids(spark, sf_dir), per_lang=None)
    # Of rows that repeat an id, all go only if all are over the limit.
    rejected = rated.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id")
    return _without(docs, rejected)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by four fifths of its five-word shingles: the smallest id, once."""
    linked = near_duplicates.link_documents(docs)
    rejected = linked.filter("NOT kept").select("doc_id").distinct()
    kept = _without(docs, rejected)
    if kept.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() == 0:
        return kept
    # Rows that repeat an id are one document: the first by its text stays; maps have no order, their text has.
    cells = [F.col(f"`{c}`") for c in kept.columns]
    order = F.struct(F.col("text").isNull(), F.col("text"), F.to_json(F.struct(*cells)))
    first = kept.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min_by(F.struct(*cells), order).alias("row"))
    return first.select("row.*").unionByName(kept.filter("doc_id IS NULL"))


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of fifty or more words that occurred before; a document without words left goes."""
    return repeats.without_repeats(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document, by words and an end token, in sequences of the permitted lengths."""
    return packing.pack_documents(docs, packing.token_count(F.col("text")))


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

# Training, connected components and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    return run_stages(spark, table(session(spark), sf_dir, "documents"), sf_dir)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over ``docs``, each written and read again."""
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = scratch_dir(spark, f"stage-{name}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    _written(spark, docs)
    return docs
