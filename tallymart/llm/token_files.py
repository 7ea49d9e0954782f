"""Token ids in files for reading single documents, compressed with a shared dictionary.

A zstandard dictionary is trained on a bounded sample of serialised ids.  Every document
is then a frame of its own, so a short one shrinks well and can be read without its
neighbours.  Documents are range-sorted by id into shard files:

    header   magic, sha256 of the dictionary
    frames   one after another, each the ids of a document as little-endian unsigned 32-bit integers
    index    for each document: id, whether it is known, offset of the frame, number of ids, crc32 of the ids
    tail     offset of the index, number of documents, magic

Tasks write to temporary names; the manifest, published last, names the files and says
how many ids stand before each.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .bpe import byte_letters
from .common import arrow_rows, scratch_dir, session, stored, table
from .registry import query
from .warc import open_store

MAGIC = b"TOKENID1"
HEADER, TAIL = len(MAGIC) + 32, 16 + len(MAGIC)
DICTIONARY_BYTES, SAMPLES, SAMPLE_IDS = 112_640, 512, 2048  # a dictionary is learned from this many runs of so many ids
SHARD_BYTES = 32 << 20  # frames of a file
MEMO = 500_000  # words that a task remembers
LEVEL = 3
MARK = "\x01"  # parts words that are encoded in one call
ENDS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)  # no apostrophe, which joins what follows
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # UTF-8 of a-z and of the small letters from U+00DF to U+00FF
# What byte vocabularies write for those letters: one printable character for each byte.
BYTES = {c: "".join(byte_letters()[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
MANIFEST = "shard int, name string, temporary string, documents long, tokens long, bytes long, sha256 string, dictionary string"
ENCODED = "doc_id long, tie long, turn long, n_tokens long, crc long, frame binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class _Numbers(dict):
    """Numbers of words in the order in which they are met first."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class WordEncoder:
    """Ids of texts by the tokenizers library.

    ``parted`` is for vocabularies whose words are runs of letters, single digits or runs
    of marks, put in small letters, with blanks left out.  A text's ids then are those of
    its words, which are numbered: a word is encoded once, and a text's ids are gathered
    by the numbers of its words.  Words that are letters throughout go straight to the
    library's model.  Otherwise texts are encoded whole.
    """

    def __init__(self, path: str, parted: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.parted, self.limit = parted, memo
        # Texts that may hold a special string are encoded whole, as it is written in them.
        self.special = sorted({t.content[:2].encode() for t in self.library.get_added_tokens_decoder().values()})
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.at, self.size, self.flat = (np.empty(0, k) for k in (np.int64, np.int64, np.uint32))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words: by the model if they are letters, else many in one call, parted by the mark."""
        out, rest, model = {}, [], self.library.model
        for w in words:
            if w.isalpha() or LETTERS.fullmatch(w):  # each letter is its own normal form
                text = w.decode()
                out[w] = [token.id for token in model.tokenize(text if w.isascii() else text.translate(BYTES))]
            else:
                rest.append(w)
        groups = [rest[i : i + 32] for i in range(0, len(rest), 32)] if self.mark is not None else [[w] for w in rest]
        for group, ids in zip(groups, self._whole([f" {MARK} ".join([w.decode() for w in g]) for g in groups])):
            cut = [-1, *(i for i, x in enumerate(ids) if x == self.mark), len(ids)]
            if len(cut) != len(group) + 1:
                raise ValueError("the vocabulary does not keep words apart")
            out.update((w, ids[a + 1 : b]) for w, a, b in zip(group, cut, cut[1:]))
        return out

    def _learn(self) -> None:
        """Encode the words that were met first since the last time."""
        words, self.numbers.new = self.numbers.new, []
        cores = [w.rstrip(ENDS) for w in words]
        # A mark after a letter or a digit begins a token.
        cores = [c if c[-1:].isalnum() else w for c, w in zip(cores, words)]
        parts = {*cores, *(w[len(c) :] for c, w in zip(cores, words) if len(c) < len(w))}
        known = self._words(list(parts))
        lists = [known[c] if len(c) == len(w) else known[c] + known[w[len(c) :]] for c, w in zip(cores, words)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        if not self.parted:
            return [np.array(ids, "<u4").tobytes() for ids in self._whole([t or "" for t in texts])]
        if len(self.numbers) > self.limit:
            self._forget()
        number, held, odd = self.numbers.__getitem__, [], {}
        for i, t in enumerate(texts):
            data = (t or "").encode()
            if b"\x01" in data or any(s in data for s in self.special):
                odd[i], data = t, b""
            words = data.lower().split()
            held.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.numbers.new:
            self._learn()
        out = []
        for which in held:
            size = self.size[which]
            place = np.repeat(self.at[which] - np.cumsum(size) + size, size)
            out.append(self.flat[place + np.arange(len(place))].astype("<u4", copy=False).tobytes())
        for i, ids in zip(odd, self._whole(list(odd.values()))):
            out[i] = np.array(ids, "<u4").tobytes()
        return out


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def train_dictionary(docs: DataFrame, tokenizer: str, parted: bool, end_id: int | None) -> bytes:
    """A dictionary learned from at most ``SAMPLES`` runs of ids: one of a document, with smallest hashes.

    The documents asked are drawn by a hash of id and text, about four times as many as are
    needed; equal runs count once.  Too few samples give a dictionary that is just their
    bytes, none at all an empty one.
    """
    rate = min(1.0, 4 * SAMPLES / max(1, docs.count()))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer, parted)
        for batch in batches:
            runs = []
            for ids in encoder.encode([t for (t,) in arrow_rows(batch, "text")]):
                ids += b"" if end_id is None else end_id.to_bytes(4, "little")
                at = zlib.crc32(ids) % max(1, -(-len(ids) // (4 * SAMPLE_IDS))) * 4 * SAMPLE_IDS
                runs.append(ids[at : at + 4 * SAMPLE_IDS])
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary())], ["ids"])

    found = drawn.select("text").mapInArrow(run, "ids binary").filter("length(ids) >= 8").distinct().orderBy(F.xxhash64("ids"), "ids").limit(SAMPLES).collect()
    samples = [bytes(r.ids) for r in found]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> dict:
    """How to hand a dictionary to zstandard; an empty one is none."""
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


class _Writer:
    """One shard file, written frame by frame."""

    def __init__(self, folder: str, dictionary: bytes):
        self.store, path = open_store(folder)
        self.temporary = f"_tmp/{uuid.uuid4().hex}.ids"
        self.store.create_dir(f"{path}/_tmp", recursive=True)
        self.out, self.sha, self.at = self.store.open_output_stream(f"{path}/{self.temporary}", compression=None), hashlib.sha256(), 0
        self.index = {"id": array("q"), "known": array("b"), "offset": array("q"), "tokens": array("q"), "crc": array("q")}
        self._write(MAGIC + hashlib.sha256(dictionary).digest())

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.at += len(data)

    def add(self, doc_id: int | None, tokens: int, crc: int, frame: bytes) -> None:
        for column, value in zip(self.index.values(), (doc_id or 0, doc_id is not None, self.at, tokens, crc)):
            column.append(value)
        self._write(frame)

    def close(self) -> dict:
        begin, n = self.at, len(self.index["id"])
        for name, column in self.index.items():
            self._write(np.array(column, "<i1" if name == "known" else "<i8").tobytes())
        self._write(begin.to_bytes(8, "little") + n.to_bytes(8, "little") + MAGIC)
        self.out.close()
        return {"temporary": self.temporary, "documents": n, "tokens": sum(self.index["tokens"]), "bytes": self.at, "sha256": self.sha.hexdigest()}


class TokenFile:
    """One shard file: its index, and any document's ids without reading the others."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        self.store, path = open_store(folder)
        self.source = self.store.open_input_file(f"{path}/{name}")
        size = self.source.size()
        tail = self._range(size - TAIL, TAIL)
        if tail[16:] != MAGIC or self._range(0, HEADER) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} is damaged or was written with another dictionary")
        self.end, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        index = self._range(self.end, 33 * n)
        at = 0
        for column, kind in (("id", "<i8"), ("known", "<i1"), ("offset", "<i8"), ("tokens", "<i8"), ("crc", "<i8")):
            setattr(self, column, np.frombuffer(index, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.start = np.cumsum(self.tokens) - self.tokens
        self.stop = np.append(self.offset[1:], self.end)
        self.unpack = zstandard.ZstdDecompressor(**_dictionary(dictionary))

    def _range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def find(self, doc_id: int | None) -> range:
        """Places of the documents of this id; rows without an id come first."""
        nulls = len(self.known) - int(self.known.sum())
        if doc_id is None:
            return range(nulls)
        low, high = np.searchsorted(self.id[nulls:], [doc_id, doc_id + 1])
        return range(nulls + int(low), nulls + int(high))

    def _ids(self, i: int, frame: bytes) -> bytes:
        ids = self.unpack.decompress(frame)
        if len(ids) != 4 * self.tokens[i] or zlib.crc32(ids) != self.crc[i]:
            raise ValueError(f"damaged document at place {i}")
        return ids

    def ids(self, i: int) -> bytes:
        """The ids of the document at a place, read from its own frame alone."""
        return self._ids(i, self._range(int(self.offset[i]), int(self.stop[i] - self.offset[i])))

    def all_ids(self, held: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
        """Places and ids of all documents, read in runs of whole frames."""
        i = 0
        while i < len(self.id):
            to = max(i + 1, int(np.searchsorted(self.stop, self.offset[i] + held, side="right")))
            begin = int(self.offset[i])
            data = self._range(begin, int(self.stop[to - 1]) - begin)
            for k in range(i, to):
                yield k, self._ids(k, data[int(self.offset[k]) - begin : int(self.stop[k]) - begin])
            i = to


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = None,
    parted: bool = False, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode whole texts and write their ids below ``folder`` in ascending order of ids; gives the manifest.

    ``tokenizer`` is the vocabulary file, ``end_id`` an id put after every document,
    ``parted`` as in ``WordEncoder``.  A null text is an empty one.  Rows without an id
    come first; rows that repeat an id stand in the order of a hash of their texts, and
    may lie in several files.  An empty table gives an empty manifest.  ``shard_bytes`` is
    the size of the frames of a file, about.
    """
    spark = session(docs.sparkSession)
    docs = _rows(docs, doc_id, text)
    dictionary = train_dictionary(docs, tokenizer, parted, end_id)
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    named = hashlib.sha256(dictionary).hexdigest()
    with store.open_output_stream(f"{path}/{named}.zdict", compression=None) as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = WordEncoder(tokenizer, parted), zstandard.ZstdCompressor(LEVEL, **_dictionary(shared.value))
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in batches:
            ids = [i + end for i in encoder.encode([t for (t,) in arrow_rows(batch, "text")])]
            made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([pack.compress(i) for i in ids], pa.binary())]
            fixed = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tie", "turn")]
            yield pa.RecordBatch.from_arrays([*fixed, *made], ["doc_id", "tie", "turn", "n_tokens", "crc", "frame"])

    # With turns, even equal rows of one id can be dealt to several files.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("turn"), "text")
    encoded = stored(keyed.mapInArrow(run, ENCODED), "token-frames")  # range bounds are then drawn from frames, not by encoding twice
    whole = encoded.agg(F.sum(F.length("frame"))).first()[0] or 0
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("turn"))
    dealt = encoded.repartitionByRange(max(1, -(-whole // shard_bytes)), *order).sortWithinPartitions(*order)
    arrow = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("dictionary", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for row in arrow_rows(batch, "doc_id", "n_tokens", "crc", "frame"):
                writer = writer or _Writer(folder, shared.value)
                writer.add(*row)
        if writer:
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": f"part-{shard:07d}.ids", "dictionary": named} | writer.close()], schema=arrow)

    draft = stored(dealt.mapInArrow(write, MANIFEST), "token-draft")  # every file is whole before the first is named

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

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    manifest = draft.mapInArrow(name, MANIFEST).drop("temporary").withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{folder}/_manifest_draft")
    store.move(f"{path}/_manifest_draft", f"{path}/manifest")
    if store.get_file_info(f"{path}/_tmp").type == pafs.FileType.Directory:
        store.delete_dir(f"{path}/_tmp")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files in ascending order of documents, and the ids before each."""
    return spark.read.schema(MANIFEST.replace("temporary string, ", "") + ", first_token long").parquet(f"{folder}/manifest")


def _opened(folder: str, name: str, named: str) -> TokenFile:
    store, path = open_store(folder)
    with store.open_input_stream(f"{path}/{named}.zdict", compression=None) as source:
        dictionary = source.read()
    if hashlib.sha256(dictionary).hexdigest() != named:
        raise ValueError("damaged dictionary")
    return TokenFile(folder, name, dictionary)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` and, if asked, ``ids`` of all documents of the files that the manifest names.

    ``start`` counts the ids of all documents before.  Every document is unpacked and
    held against the crc32 in the index.
    """
    session(spark)
    files = read_manifest(spark, folder).select("name", "dictionary", "first_token")
    kinds = [pa.int64()] * 4 + ([pa.list_(pa.uint32())] if with_ids else [])
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, named, first in arrow_rows(batch, "name", "dictionary", "first_token"):
                with _opened(folder, name, named) as file:
                    rows, held = [], 0
                    for i, ids in file.all_ids():
                        row = [int(file.id[i]) if file.known[i] else None, first + int(file.start[i]), int(file.tokens[i]), zlib.crc32(ids)]
                        rows.append(row + ([np.frombuffer(ids, "<u4")] if with_ids else []))
                        held += len(ids) if with_ids else 64
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    if with_ids:  # Spark has no unsigned integers
        kinds[-1] = pa.list_(pa.int64())
    return files.repartition(max(1, files.count())).mapInArrow(run, READ + (", ids array<long>" if with_ids else ""))


def fetch_documents(spark: SparkSession, folder: str, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)`` of the ``wanted`` ids: indexes are read, and of the frames only those asked for."""
    session(spark)
    files = read_manifest(spark, folder).select("name", "dictionary")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, named in arrow_rows(batch, "name", "dictionary"):
                with _opened(folder, name, named) as file:
                    for at in range(0, len(file.id), 100_000):
                        ids = pa.array(file.id[at : at + 100_000], mask=file.known[at : at + 100_000] == 0)
                        n = len(ids)
                        yield pa.RecordBatch.from_arrays([ids, pa.array([name] * n), pa.array([named] * n), pa.array(np.arange(at, at + n))], ["doc_id", "name", "dictionary", "place"])

    places = files.repartition(max(1, files.count())).mapInArrow(index, "doc_id long, name string, dictionary string, place long")
    ids = wanted.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    asked = places.join(ids, "doc_id", "left_semi")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        for batch in batches:
            for number, name, named, place in arrow_rows(batch, "doc_id", "name", "dictionary", "place"):
                if name != opened:
                    if file:
                        file.source.close()
                    file, opened = _opened(folder, name, named), name
                ids = pa.array([np.frombuffer(file.ids(place), "<u4")], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids], ["doc_id", "ids"])
        if file:
            file.source.close()

    return asked.sortWithinPartitions("name", "place").mapInArrow(get, "doc_id long, ids array<long>")


@query("op12_token_files")
def token_files(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read back from them."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_dir(spark, "token-files")
    # This vocabulary keeps blanks and marks apart from letters, so its words can be encoded one by one.
    write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1, parted=True)
    return read_token_files(spark, folder)
