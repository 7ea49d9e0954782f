"""Language identification: averaged hashed subword embeddings with a linear softmax.

Letters of the lower-cased text, with every other character as a word edge, are cut
into subwords of one to four characters.  Each subword hashes to a row of an embedding
table; a text is the mean of its rows, followed by a linear softmax.  Both are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows.  A
temperature and the lowest accepted score are set on a part of the sample that the
descent does not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import arrow_rows, session, smallest_of, table
from .registry import query

BUCKETS = 1 << 15
UNDECIDED = "und"


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


PART = 1 << 18  # code points that are looked at together
BREAK = re.compile(r"\s")


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about ``size`` code points, cut at white space only, so no subword is cut."""
    at = 0
    while len(text) - at > size:
        cut = BREAK.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def subwords(text: str, letters: np.ndarray) -> np.ndarray:
    """Bucket numbers of a text's subwords; none if it has no letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[np.minimum(codes, 0x10FFFF)]
    if not is_letter.any():
        return np.empty(0, np.int64)
    codes = np.where(is_letter, codes, np.uint32(32))
    ids, n = [], len(codes)
    key = np.zeros(n, np.uint32)
    for size in range(1, 5):
        if n < size:
            break
        # A window may begin or end at a word's edge but not cross it.
        key = key[: n - size + 1] * np.uint32(0x01000193) + codes[size - 1 :]
        if size == 1:
            ok = is_letter
        elif size == 2:
            ok = is_letter[:-1] | is_letter[1:]
        elif size == 3:
            ok = is_letter[1:-1]
        else:
            ok = is_letter[1:-2] & is_letter[2:-1]
        mixed = (key[ok] + np.uint32(size)) * np.uint32(0x9E3779B1)
        ids.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(17))
    return np.concatenate(ids).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # per bucket: its embedding times the output weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def score(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float, bool]:
        mean, n = 0.0, 0
        for part in parts_of(text or ""):  # a very long text is never held as subwords as a whole
            if len(ids := subwords(part, letters)):
                mean = mean + (self.table[ids].mean(axis=0, dtype=np.float64) - mean) * (len(ids) / (n + len(ids)))
                n += len(ids)
        if not n or not self.langs:
            return UNDECIDED, 0.0, False
        p = self.score(mean)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def _train(langs: list[str], rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, epochs: int) -> Model:
    """Descent over ``(buckets, shares, label)`` rows; every fifth row is left for the calibration."""
    rng = np.random.default_rng(7)
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or fit
    emb = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (dims, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    size, steps, step = 32, max(1, epochs * ((len(fit) + 31) // 32)), 0
    while step < steps:
        order = rng.permutation(len(fit))
        for at in range(0, len(fit), size):
            part = [fit[i] for i in order[at : at + size]]
            rate = 2.0 * (1 - step / steps)
            x = np.stack([share @ emb[ids] for ids, share, _ in part])
            z = x @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [y for _, _, y in part]] -= 1
            p /= len(part)
            back = p @ out.T
            out -= rate * (x.T @ p)
            bias -= rate * p.sum(axis=0)
            for (ids, share, _), g in zip(part, back):
                emb[ids] -= 20 * rate * share[:, None] * g[None, :]
            step += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64))
    logits = np.stack([share @ model.table[ids] + model.bias for ids, share, _ in held])
    truth = np.array([y for _, _, y in held])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    p = probabilities(model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    # Rejection: all but one in a thousand right answers stay, and a clear majority always does.
    model.threshold = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return model


def fit(labelled: DataFrame, per_lang: int = 300, dims: int = 16, epochs: int = 12) -> Model:
    """Train on at most ``per_lang`` rows of each language of ``labelled(doc_id, text, lang)``.

    The rows of a language with the smallest hashes of their id are taken, so the sample
    does not depend on the layout.  The driver gets their subword counts only: at most
    ``per_lang`` rows a language with up to ``BUCKETS`` numbers each.
    """
    spark = session(labelled.sparkSession)
    letters = spark.sparkContext.broadcast(letter_table())
    usable = labelled.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    # Far under per_lang * languages rows of two values: a bounded broadcast.
    chosen = smallest_of(usable.select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_lang).distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, cells = [], [], []
            for doc_id, text, lang in arrow_rows(batch, "doc_id", "text", "lang"):
                total = np.zeros(BUCKETS, np.int64)
                for part in parts_of(text):
                    total += np.bincount(subwords(part, letters.value), minlength=BUCKETS)
                if bucket := np.flatnonzero(total).tolist():
                    count = total[bucket]
                    ids.append(doc_id)
                    langs.append(lang)
                    cells.append(np.stack([bucket, count]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(cells, pa.binary())], ["doc_id", "lang", "cells"]
            )

    rows = (
        usable.select(F.col("doc_id").cast("long"), "text", "lang")
        .join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), "lang")), ["doc_id", "lang"], "left_semi")
        .mapInArrow(features, "doc_id long, lang string, cells binary")
        .groupBy("doc_id", "lang").agg(F.min("cells").alias("cells"))
        .collect()
    )
    rows.sort(key=lambda r: ((r.doc_id * 0x9E3779B97F4A7C15) % 2**64, r.doc_id, r.lang))
    langs = sorted({r.lang for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    data = []
    for r in rows:
        bucket, count = np.frombuffer(r.cells, "<u4").reshape(2, -1).astype(np.int64)
        data.append((bucket, (count / count.sum()).astype(np.float32), langs.index(r.lang)))
    return _train(langs, data, dims, epochs)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``accepted``.

    A null text and one without a letter give ``und``, 0 and false; so does every text if
    nothing was learned.  Columns of these names are replaced, all others stay.
    """
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model, letter_table()))
    docs = docs.drop("lang_pred", "score", "accepted")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, accepted boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = shared.value
        for batch in batches:
            found = [model.predict(t, letters) for (t,) in arrow_rows(batch, text)]
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "lang_pred", "score", "accepted"])

    return docs.mapInArrow(run, schema)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


@query("op5_language_id")
def language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").filter(remainder(F.col("doc_id"), 3) != 1))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "accepted"
    )
