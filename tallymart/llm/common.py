"""What the text operators share: reading, scratch tables, words, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import DEFAULTS, configure, scratch_dir as _scratch_dir
from ..sources.writers import Folder

__all__ = ["session", "table", "scratch_dir", "stored", "words_of", "split_words", "components", "word_keys"]

# Arrow batches stay small however long single texts are.
BATCH_ROWS, BATCH_BYTES = "1000", str(8 << 20)


# Where ``scratch_dir`` notes the folders that it makes, if anyone asks for it.
_NOTES: list[list[str]] = []


@contextmanager
def noted_scratch() -> Iterator[list[str]]:
    """The scratch folders that are made inside, for a caller who removes them when results are written."""
    _NOTES.append([])
    try:
        yield _NOTES[-1]
    finally:
        _NOTES.pop()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared scratch folder, with its file system named, as tasks that write files have no default one."""
    path = _scratch_dir(spark, purpose)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        folder = Folder(spark, path)
        path = folder.fs.makeQualified(folder.make(path)).toString()
    for note in _NOTES:
        note.append(path)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written once to the shared scratch folder and read back: lost executors cost nothing."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query has shuffled goes when it ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_scratch(spark: SparkSession, paths: list[str], but_for: DataFrame) -> None:
    """Remove scratch folders, except those that ``but_for`` reads, and forget them."""
    read = but_for.inputFiles() if paths else []
    for path in list(paths):
        folder = path.rstrip("/").rpartition("/")[2]  # a name of its own; file systems are written in several ways
        if not any(f"/{folder}/" in name for name in read):
            Folder(spark, path).delete()
            paths.remove(path)


def session(spark: SparkSession) -> SparkSession:
    """Session settings that bound a task's Arrow batches and let hot join keys be split."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    for key in ("spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, DEFAULTS[key])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def smallest_of(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The ``k`` first rows of each group by ``order``, whose first part is a hash.

    A group is first cut by that hash, so no task sees all rows of a large one: the last
    step has at most ``k`` rows of each cut.
    """
    cut = F.pmod(order[0], F.lit(256))
    columns = [F.col(f"`{c}`") for c in df.columns]
    rank = F.row_number().over(Window.partitionBy(*group, cut).orderBy(*order))
    few = df.select(*columns, rank.alias("_rank")).filter(F.col("_rank") <= k).select(*columns)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return few.select(*columns, rank.alias("_rank")).filter(F.col("_rank") <= k).select(*columns)


def split_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z in lower case.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is the rule.
    """
    return data.lower().split()


def words_of(text: Column) -> Column:
    """The same words as an array column, in the JVM."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[ \\t-\\r]+"), lambda w: w != "")


class word_keys(dict):
    """Stable 64-bit keys of words, kept for words seen before up to ``limit`` of them."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        key = self[word] = self.hash(word)
        return key


def arrow_rows(batch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch as Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``edges(a, b)``.

    Every round takes the smallest label among neighbours and then the label
    of that label, so long chains shrink by powers.  Each round is a pair of
    joins and partial aggregates, stored in the shared folder; only the count
    of changed labels reaches the driver.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stored(both.filter("a <> b").distinct(), purpose)
    labels = stored(
        links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")),
        purpose,
    )
    while True:
        near = (
            links.join(labels, links.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("up"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new = lower.join(up, "up", "left").select("node", "old", F.least("up", F.coalesce("top", "up")).alias("component"))
        step = stored(new, purpose)
        labels = step.select("node", "component")
        if step.filter("old <> component").limit(1).count() == 0:
            return labels


def mix64(x):
    """Finalising mix of 64-bit values, so that every output bit hangs on every input bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def key_array(words: list[bytes], keys: word_keys):
    """The 64-bit keys of words as an array."""
    import numpy as np

    return np.fromiter(map(keys.__getitem__, words), np.uint64, len(words))


def run_keys(word, size: int):
    """Keys of all runs of ``size`` neighbouring words; none if there are fewer words."""
    import numpy as np

    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = word[:n].copy()
    for j in range(1, size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[j : n + j]
    return mix64(key)


def shingle_set(text: str | None, keys: word_keys, size: int):
    """Distinct keys of the ``size``-word shingles in ascending order; fewer words make one shingle, none make none."""
    import numpy as np

    words = split_words(text.encode()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(run_keys(key_array(words, keys), min(size, len(words))))
