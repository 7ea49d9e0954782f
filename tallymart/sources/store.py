"""Stored tables that change all at once.

A store is a folder with tables, each in chunks: one folder for each value of its chunk
column.  A transaction writes new chunk folders beside the old ones, below a name of its
own, and then publishes one manifest that says which folders make up every table.
Publishing is a rename that fails if another transaction was faster, so readers see all
of a transaction or nothing of it, and what a lost driver leaves is never read.

    <root>/<table>/_w=<transaction>/<chunk column>=<value>/part-...parquet
    <root>/_manifests/00000007.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import stored
from .writers import Folder, by_time, latest_by, with_chunk

WRITER = "_w"  # which transaction wrote a folder
NULL_CHUNK = "__HIVE_DEFAULT_PARTITION__"
WHOLE = ""  # the only chunk of a table without a chunk column


class Conflict(RuntimeError):
    """Another transaction was published since this one began."""


class Store:
    """Versions of the tables below a folder; version 0 has none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.root = self.folder.path

    def _names(self, below: str) -> list[str]:
        if not self.folder.exists(below):
            return []
        return sorted(s.getPath().getName() for s in self.folder.fs.listStatus(self.folder.make(self.root + below)))

    def version(self) -> int:
        return max((int(n[:-5]) for n in self._names("/_manifests") if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version is made of; one entry for each stored chunk."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "notes": {}}
        jvm = self.spark.sparkContext._jvm
        source = self.folder.fs.open(self.folder.make(f"{self.root}/_manifests/{version:08d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, table: str, version: int | None = None, chunks: list[str] | None = None) -> DataFrame:
        """A table as of a version, by default the newest; ``chunks`` names the only ones to read."""
        return self._frame(table, self.manifest(version)["tables"][table], chunks)

    def _frame(self, table: str, entry: dict, chunks: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        folders = [
            f"{self.root}/{table}/{WRITER}={w}" + (f"/{entry['chunk']}={value}" if entry["chunk"] else "")
            for value, writers in entry["chunks"].items() if chunks is None or value in chunks for w in writers
        ]
        if not folders:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField(WRITER, T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.root}/{table}").parquet(*folders)
        return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields])

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Changes that are published together at the end of the block, or not at all if it raises."""
        change = Transaction(self)
        try:
            yield change
            change.publish()
        except BaseException:
            change.discard()
            raise

    def vacuum(self, keep: int = 2, running: tuple[str, ...] = ()) -> int:
        """Delete folders that the last ``keep`` versions do not name; readers of older versions must be done.

        Folders of transactions that are not published yet look the same as those of lost
        ones: name the writers that are still at work in ``running``.
        """
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        named = {(t, w) for m in kept for t, e in m["tables"].items() for writers in e["chunks"].values() for w in writers}
        gone = 0
        for table in [n for n in self._names("") if not n.startswith("_")]:
            for folder in self._names(f"/{table}"):
                writer = folder.partition("=")[2]
                if writer not in running and (table, writer) not in named:
                    self.folder.delete(f"/{table}/{folder}")
                    gone += 1
        for name in self._names("/_manifests"):
            if name[0].isdigit() and int(name[:-5]) <= last - keep:
                self.folder.delete(f"/_manifests/{name}")
        return gone


class Transaction:
    """Changes to some tables of a store, based on the version that was newest when it began."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.base = store.manifest()
        self.tables: dict[str, dict] = {t: e | {"chunks": dict(e["chunks"])} for t, e in self.base["tables"].items()}
        self.notes: dict = dict(self.base["notes"])
        self.name = uuid.uuid4().hex
        self.step = 0
        self.changed: set[str] = set()

    def has(self, table: str) -> bool:
        return table in self.tables

    def read(self, table: str, chunks: list[str] | None = None) -> DataFrame:
        """A table as this transaction has it so far."""
        return self.store._frame(table, self.tables[table], chunks)

    def _write(self, table: str, rows: DataFrame, chunk: str | None, writer: str | None = None) -> tuple[str, list[str]]:
        """Store rows below a fresh name, or beside those of a ``writer`` of this transaction; which, and the chunks that lie there."""
        if writer is None:
            self.step += 1
            writer = f"{self.name}-{self.step}"
        self.changed.add(table)
        path = f"/{table}/{WRITER}={writer}"
        rows = rows if chunk is None else by_time(rows, chunk)
        out = rows.write.mode("append").option("compression", "zstd")
        if chunk is None:
            out.parquet(self.store.root + path)
            return writer, [WHOLE]
        out.partitionBy(chunk).parquet(self.store.root + path)
        return writer, [n.partition("=")[2] for n in self.store._names(path) if n.startswith(f"{chunk}=")]

    def replace(self, table: str, rows: DataFrame, chunk: str | None = None) -> None:
        """All rows of a table."""
        writer, chunks = self._write(table, rows, chunk)
        self.tables[table] = {"chunk": chunk, "schema": rows.schema.jsonValue(), "chunks": {c: [writer] for c in chunks}}

    def append(self, table: str, rows: DataFrame, chunk: str | None = None) -> None:
        """Further rows, as folders beside those that a chunk has."""
        if table not in self.tables:
            return self.replace(table, rows, chunk)
        entry = self._same(table, rows, chunk)
        writer, chunks = self._write(table, rows.select(*[f["name"] for f in entry["schema"]["fields"]]), entry["chunk"])
        for c in chunks:
            entry["chunks"][c] = [*entry["chunks"].get(c, []), writer]

    def replace_chunks(self, table: str, rows: DataFrame, chunk: str, chunks: list[str]) -> None:
        """The rows of the named chunks; a named chunk without rows goes, all others stay."""
        if table not in self.tables:
            return self.replace(table, rows, chunk)
        entry = self._same(table, rows, chunk)
        writer, found = self._write(table, rows.select(*[f["name"] for f in entry["schema"]["fields"]]), chunk)
        if extra := set(found) - set(chunks):
            raise ValueError(f"rows of {table} outside the chunks to replace: {sorted(extra)[:3]}")
        for c in chunks:
            entry["chunks"].pop(c, None)
        entry["chunks"].update({c: [writer] for c in found})

    def _same(self, table: str, rows: DataFrame, chunk: str | None) -> dict:
        entry = self.tables[table]
        if entry["chunk"] != chunk or {f["name"] for f in entry["schema"]["fields"]} != set(rows.columns):
            raise ValueError(f"{table} is stored by {entry['chunk']} with other columns")
        return entry

    def merge(self, table: str, rows: DataFrame, keys: list[str], chunk: str | None = None) -> list[str]:
        """New rows replace stored ones of the same keys; the chunks that have changed.

        New rows are written once.  Only chunks with stored rows of their keys are read whole
        and written again, without those; a chunk that merely gets new rows has them in a
        folder beside its others, which ``compact`` puts together when they are many.  A null
        in the chunk column is a chunk like any other.  New rows must not repeat a key; a row
        with a null key is always added.
        """
        if table not in self.tables:
            self.replace(table, rows, chunk)
            return list(self.tables[table]["chunks"])
        types = {f.name: f.dataType for f in T.StructType.fromJson(self.tables[table]["schema"])}
        if chunk is None and (self.tables[table]["chunk"] is not None or types != {f.name: f.dataType for f in rows.schema}):
            rows = stored(rows, "merge-new")  # the table takes the columns of the new rows
            self.replace(table, self.read(table).join(rows.select(*keys), keys, "left_anti").select(*rows.columns).unionAll(rows))
            return [WHOLE]
        entry = self._same(table, rows, chunk)
        writer, found = self._write(table, rows.select(*[F.col(f"`{n}`").cast(kind).alias(n) for n, kind in types.items()]), chunk)
        new = self.store._frame(table, entry | {"chunks": {c: [writer] for c in found}}).select(*keys)
        marks = [] if chunk is None else [F.col(chunk).cast("string").alias("_chunk")]
        gone = stored(self.read(table).select(*keys, *marks).join(new, keys, "left_semi"), "merge-replaced")
        if chunk is None:
            touched = [] if gone.isEmpty() else [WHOLE]
        else:
            touched = [_chunk_name(v) for (v,) in gone.select("_chunk").distinct().collect()]  # a value for each chunk reaches the driver
        here = found
        if touched:
            kept = self.read(table, touched).join(gone.select(*keys), keys, "left_anti").select(*types)
            here = self._write(table, kept, chunk, writer)[1]
        for c in {*touched, *found}:
            if c in here:
                entry["chunks"][c] = [writer] if c in touched else [*entry["chunks"].get(c, []), writer]
            else:
                entry["chunks"].pop(c)
        self.compact(table)
        return sorted({*touched, *found})

    def compact(self, table: str, folders: int = 8) -> list[str]:
        """Rewrite each chunk that lies in more than ``folders`` folders as one; readers keep what they have."""
        entry = self.tables[table]
        many = [c for c, writers in entry["chunks"].items() if len(writers) > folders]
        if many:
            rows = self.read(table, many)
            if entry["chunk"] is None:
                self.replace(table, rows)
            else:
                self.replace_chunks(table, rows, entry["chunk"], many)
        return many

    def publish(self) -> int:
        """Make the changes the newest version; raises ``Conflict`` if the base is not the newest any more."""
        if self.tables == self.base["tables"] and self.notes == self.base["notes"]:
            return self.base["version"]
        version = self.base["version"] + 1
        folder, jvm = self.store.folder, self.spark.sparkContext._jvm
        final = folder.make(f"{self.store.root}/_manifests/{version:08d}.json")
        draft = folder.make(f"{self.store.root}/_manifests/_{self.name}.json")
        out = folder.fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "tables": self.tables, "notes": self.notes}).encode()))
        out.close()
        # Unlike the file system's own rename, this one fails if the name is taken.
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(folder.fs.makeQualified(draft), folder.fs.makeQualified(final), none)
        except Exception as e:
            folder.fs.delete(draft, False)
            if folder.fs.exists(final):
                raise Conflict(f"version {version} of {self.store.root} was published by another writer") from e
            raise
        return version

    def discard(self) -> None:
        """Remove what was written, as far as the store can be reached."""
        for table in self.changed:
            for step in range(1, self.step + 1):
                try:
                    self.store.folder.delete(f"/{table}/{WRITER}={self.name}-{step}")
                except Exception:  # noqa: BLE001  the first error is the one to see; what is left is never read
                    return


def _chunk_name(value: str | None) -> str:
    return NULL_CHUNK if value is None else value


def merge_fact(change: Transaction, table: str, rows: DataFrame, keys: list[str], column: str = "order_date", chunk: str = "day") -> list[str]:
    """Merge a fact by key into chunks of a day, week or month of its date."""
    rows, part = with_chunk(rows, column, chunk)
    return change.merge(table, rows, keys, part)


def merge_dimension(change: Transaction, table: str, rows: DataFrame, key: str, order_by: Column | str | None = None, buckets: int = 1) -> list[str]:
    """Merge a dimension by key; ``order_by`` picks the greatest of new rows that repeat one.

    With ``buckets``, rows are stored by a hash of the key, and only buckets with new rows
    are written again.
    """
    rows = rows if order_by is None else latest_by(rows, key, order_by)
    if buckets == 1:
        return change.merge(table, rows, [key])
    return change.merge(table, rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), [key], "_bucket")


def changed_chunks(before: dict | None, after: dict) -> list[str]:
    """Chunks of a table whose folders differ between two manifest entries."""
    old = before["chunks"] if before else {}
    return sorted(c for c in {*old, *after["chunks"]} if old.get(c) != after["chunks"].get(c))
