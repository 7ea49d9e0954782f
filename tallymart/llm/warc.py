"""Web archive (WARC 1.1) writer and reader over sharded, gzip-compressed files.

Records are range-sorted by key into shards whose bounds follow from the data alone, so
the same input gives the same files.  Within a shard a file is closed when its compressed
size would pass a limit.  Headers, record ids and digests are made anew from the payload.
Tasks write to temporary names and hand in a manifest row per file; only when all have
ended are the named files moved to their final names and the manifest is published.  An
attempt that is lost or repeated leaves nothing but temporary files, which are removed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_rows, scratch_dir, session, stored, table
from .registry import query

MANIFEST = "shard int, name string, temporary string, records long, bytes long, sha256 string, first_key long, last_key long"
RECORD = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, position long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that tasks can write to (mounted folder, HDFS, S3, GCS) and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _record_id(key) -> str:
    return f"<urn:x-record:{'' if key is None else key}>"


def target_uri(key, url: str | None) -> str:
    """The address of a record: the url with what an address may not hold percent-encoded; for rows without a url one made from the key."""
    if not url:
        return f"urn:x-page:{'' if key is None else key}"
    return quote(url.encode("utf-8", "surrogatepass"), safe="%:/?#[]@!$&'()*+,;=-._~")


def _record(key, url, payload: bytes, kind: str, digest: str, refers_to, date: str) -> bytes:
    """One archive record; a revisit has the response's headers but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(key)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    address = target_uri(key, url)
    head.append(f"WARC-Target-URI: {address}")
    if url is not None and address != url:  # any text may stand in a url column; what it was is kept beside its address
        head.append("X-Source-URI-Base64: " + base64.b64encode(url.encode("utf-8", "surrogatepass")).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roll:
    """The files of one shard, each closed before its compressed size would pass ``limit``."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.folder, self.shard, self.limit, self.number, self.out = folder, shard, limit, 0, None
        self.store, self.path = open_store(folder)

    def add(self, key, data: bytes) -> dict | None:
        """Write a member; the manifest row of the file that it closed, if any."""
        member, done = _gzip(data), None
        if self.out is not None and self.row["bytes"] + len(member) > self.limit:
            done = self.close()
        if self.out is None:
            temporary = f"_tmp/{uuid.uuid4().hex}.warc.gz"
            self.store.create_dir(f"{self.path}/_tmp", recursive=True)
            self.out, self.sha = self.store.open_output_stream(f"{self.path}/{temporary}", compression=None), hashlib.sha256()
            self.row = {"shard": self.shard, "name": f"part-{self.shard:06d}-{self.number:05d}.warc.gz", "temporary": temporary, "records": 0, "bytes": 0, "first_key": key}
            self.number += 1
        self.out.write(member)
        self.sha.update(member)
        self.row["records"] += 1
        self.row["bytes"] += len(member)
        self.row["last_key"] = key
        return done

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return self.row | {"sha256": self.sha.hexdigest()}


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Upper key bounds of shards with about ``shard_bytes`` bytes of ``sizes(key, size)``.

    Key ranges are counted in cells; a cell that is too heavy is cut again, until it fits
    or holds one key.  Only cell sums reach the driver, a few for each shard.
    """
    total, low, high = sizes.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    if low is None or total <= shard_bytes:
        return []
    parts = 16
    cells = [(low, high, total)]
    while heavy := [c for c in cells if c[2] > shard_bytes / 2 and c[0] < c[1]]:
        cuts = []
        for first, last, _ in heavy:
            n = min(max(parts, parts * -(-total // shard_bytes) // len(heavy)), last - first + 1, 4096)
            cuts += [first + (last - first + 1) * i // n for i in range(n)]
        heavy_set = set(heavy)
        edges = sorted({*cuts, *(c[0] for c in cells)})
        spark = sizes.sparkSession
        bounds = spark.sparkContext.broadcast(edges)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            at = np.array(bounds.value, np.int64)
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                cell = np.searchsorted(at, keys, side="right") - 1
                found, where = np.unique(cell, return_inverse=True)
                sums = np.bincount(where, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(at[found]), pa.array(sums.astype(np.int64))], ["key", "size"])

        counted = dict(
            (r[0], r[1]) for r in sizes.filter("key IS NOT NULL").select("key", "size").mapInArrow(place, "key long, size long").groupBy("key").agg(F.sum("size")).collect()
        )
        cells = [(e, (edges[i + 1] - 1) if i + 1 < len(edges) else high, counted.get(e, 0)) for i, e in enumerate(edges)]
        if set(c for c in cells if c[2] > shard_bytes / 2 and c[0] < c[1]) == heavy_set:
            break
    bounds_out, run = [], 0
    for first, last, size in cells:
        if run and run + size > shard_bytes:
            bounds_out.append(first)
            run = 0
        run += size
    return bounds_out


def write_warc(
    spark: SparkSession, records: DataFrame, folder: str, file_bytes: int = 8 << 20, shard_bytes: int = 64 << 20,
    revisit_from: int = 100, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Archive ``records(key, url, payload)`` below ``folder``; gives the manifest.

    A null payload is an empty one.  Of records with equal payloads of at least
    ``revisit_from`` bytes, the one with the smallest key is a response and the others
    revisit it; rows that repeat that key are revisits of it, except one.  Rows without a
    key are responses, as nothing could refer to them, and stand in shards of their own in
    front.  An empty table gives an empty
    manifest and no file.  ``file_bytes`` bounds a file's compressed size (a single
    larger record has a file of its own); ``shard_bytes`` is the payload that one task
    sorts and writes.
    """
    session(spark)
    rows = records.select(
        F.col("key").cast("long").alias("key"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("payload").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    narrow = rows.select("key", F.octet_length("payload").alias("size"), F.sha2("payload", 256).alias("digest"))
    # Of equal payloads, who comes first: one partial aggregate, then a join whose hot keys Spark splits.
    large = narrow.filter((F.col("size") >= revisit_from) & F.col("key").isNotNull())
    first = large.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    spread = F.xxhash64("digest")
    later = (
        large.select("key", "digest").withColumn("_spread", spread)
        .join(first.withColumn("_spread", spread), ["digest", "_spread"])
        .select("key", "digest", "first").distinct()
    )
    bounds = shard_bounds(narrow.select("key", "size"), shard_bytes)
    # Rows without a key have shards of their own before the others, by a hash of what they hold.
    keyless = -(-(narrow.filter("key IS NULL").agg(F.sum("size") + F.count("*")).first()[0] or 0) // shard_bytes)
    shared = spark.sparkContext.broadcast(bounds)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at = np.array(shared.value, np.int64)
        for batch in batches:
            keys, mixed = batch.column(0), batch.column(batch.num_columns - 1).to_numpy()
            place = keyless + np.searchsorted(at, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            place = np.where(keys.is_null().to_numpy(zero_copy_only=False), mixed % max(keyless, 1), place).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), *batch.columns[:-1]], ["shard", *batch.schema.names[:-1]])

    # Rows and notes on later copies meet by key in one sort: the notes (kind 0) come first.
    wide = rows.select("key", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    notes = later.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    mixed = F.when(F.col("key").isNull(), F.xxhash64("url", "payload")).otherwise(0)
    placed = wide.unionAll(notes).withColumn("mixed", mixed).mapInArrow(shard, "shard int, key long, kind int, url string, payload binary, digest string, first long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, notes, notes_key, given = None, {}, None, set()
        schema = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64())])
        batch_of = lambda row: pa.RecordBatch.from_pylist([row], schema=schema)
        for batch in batches:
            for at, key, kind, url, payload, digest, first in arrow_rows(batch, "shard", "key", "kind", "url", "payload", "digest", "first"):
                if roll is None or roll.shard != at:
                    if roll is not None and (done := roll.close()):
                        yield batch_of(done)
                    roll, notes_key = _Roll(folder, at, file_bytes), object()
                if key != notes_key:
                    notes, notes_key, given = {}, key, set()
                if kind == 0:
                    notes[digest] = first
                    continue
                digest = hashlib.sha256(payload).hexdigest()
                refers = notes.get(digest)
                if refers == key and digest not in given:
                    refers = None
                    given.add(digest)
                kind = "response" if refers is None else "revisit"
                if done := roll.add(key, _record(key, url, payload, kind, digest, refers, date)):
                    yield batch_of(done)
        if roll is not None and (done := roll.close()):
            yield batch_of(done)

    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    order = ("shard", F.col("key").asc_nulls_first(), "kind", "url", "payload")
    sharded = placed.repartitionById(keyless + len(bounds) + 1, F.col("shard")).sortWithinPartitions(*order)
    draft = stored(sharded.mapInArrow(write, MANIFEST), "warc-draft")  # every file is written before the first is named

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for final, temporary in arrow_rows(batch, "name", "temporary"):
                try:
                    store.move(f"{path}/{temporary}", f"{path}/{final}")
                except OSError:  # a repeated task: the file has its name already
                    if store.get_file_info(f"{path}/{final}").type != pafs.FileType.File:
                        raise
            yield batch

    manifest = draft.mapInArrow(name, MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest_draft")
    store.move(f"{path}/_manifest_draft", f"{path}/manifest")
    if store.get_file_info(f"{path}/_tmp").type == pafs.FileType.Directory:
        store.delete_dir(f"{path}/_tmp")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Members:
    """Records of an archive file, member by member, without holding the file."""

    def __init__(self, source):
        self.source, self.data = source, b""

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        position = 0
        while True:
            unpack, out, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                if not self.data:
                    self.data = self.source.read(1 << 20)
                    if not self.data:
                        if used:
                            raise ValueError("archive ends within a record")
                        return
                used += len(self.data)
                out.append(unpack.decompress(self.data))
                self.data = unpack.unused_data
            yield position, b"".join(out)
            position += used - len(self.data)


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; checks lengths and digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:x-record:").rstrip(">")) else None
    raw, address = fields.get("X-Source-URI-Base64"), fields["WARC-Target-URI"]
    url = base64.b64decode(raw).decode("utf-8", "surrogatepass") if raw is not None else None if address.startswith("urn:x-page:") else address
    return {
        "key": number("WARC-Record-ID"), "url": url,
        "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload,
    }


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of the files that the manifest names, with every digest checked."""
    schema = RECORD + (", payload binary" if with_payload else "")
    names = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name", "bytes")
    n_files = max(1, names.count())
    kinds = {"key": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "position": pa.int64()}
    kinds |= {"payload": pa.binary()} if with_payload else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        arrow = pa.schema(list(kinds.items()))
        for batch in batches:
            for (name,) in arrow_rows(batch, "name"):
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for position, data in _Members(source):
                        row = parse_record(data) | {"file": name, "position": position}
                        rows.append({k: row[k] for k in kinds})
                        held += len(data) if with_payload else 256
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return names.repartition(min(n_files, 10_000), "name").mapInArrow(read, schema)


WARC_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


@query("op1_warc", WARC_SQL)
def warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages and read the archives back."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload"))
    folder = scratch_dir(spark, "warc")
    write_warc(spark, pages, folder)
    return read_warc(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
