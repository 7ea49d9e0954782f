import gzip
import hashlib
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from tallymart.llm.warc import read_warc, write_warc

BIG = "x" * 150
ROWS = [
    (3, "http://a/", BIG), (1, None, BIG), (2, "http://b/\r\nEvil: 1", "small"), (4, "u", "small"), (5, "u", None),
    (6, "u", ""), (7, "é", "é" * 50), (8, "é", "é" * 50), (9, "u", "long " * 30_000), (1, None, BIG), (None, "u", BIG),
]


def written(spark, folder, rows=ROWS, **options):
    df = spark.createDataFrame(rows, "key long, url string, payload string").withColumn("shard", F.lit(1)).withColumn("digest", F.lit("x"))
    return write_warc(spark, df.repartition(4), str(folder), **options).collect()


def files(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder) if n.endswith(".gz")}


def test_round_trip_and_revisits(spark, tmp_path):
    manifest = written(spark, tmp_path / "w", file_bytes=600, shard_bytes=1000)
    rows = read_warc(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(rows) == len(ROWS) and sum(m.records for m in manifest) == len(ROWS) and len(manifest) > 3
    key = lambda x: tuple((v is not None, v) for v in x)
    want = sorted(((k, u, hashlib.sha256((p or "").encode()).hexdigest(), len((p or "").encode())) for k, u, p in ROWS), key=key)
    assert sorted(((r.key, r.url, r.payload_digest, r.payload_bytes) for r in rows), key=key) == want
    kinds = sorted(((r.key, r.record_type, r.refers_to) for r in rows), key=key)
    assert kinds == sorted([(None, "response", None), (1, "response", None), (1, "revisit", 1), (2, "response", None), (3, "revisit", 1), (4, "response", None),
                            (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (9, "response", None)], key=key)
    assert {bytes(r.payload) for r in rows if r.key == 9} == {("long " * 30_000).encode()}


def test_files_are_equal_on_a_second_run(spark, tmp_path):
    one, two = (sorted((m.name, m.sha256, m.records, m.bytes) for m in written(spark, tmp_path / n, file_bytes=600, shard_bytes=1000)) for n in "ab")
    assert one == two
    here = files(tmp_path / "a")
    assert here == files(tmp_path / "b") and not os.path.exists(tmp_path / "a/_tmp")
    assert {n: hashlib.sha256(d).hexdigest() for n, d in here.items()} == {n: s for n, s, _, _ in one}
    assert all(b <= 600 or r == 1 for _, _, r, b in one)
    keys = []
    for n in sorted(here):  # name order is key order
        keys += [line.split(b":")[-1].strip(b">\r") for line in gzip.decompress(here[n]).split(b"\n") if line.startswith(b"WARC-Record-ID")]
    assert keys == [b"", b"1", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"]


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "key long, url string, payload string")
    assert write_warc(spark, empty, str(tmp_path / "w")).collect() == [] and read_warc(spark, str(tmp_path / "w")).collect() == []


def plain_records(folder):
    """Headers of all records, read by nothing but gzip and line splitting."""
    out = []
    for name, data in sorted(files(folder).items()):
        whole = gzip.decompress(data)
        while whole:
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode("ascii").split("\r\n")[1:])
            n = int(fields["Content-Length"])
            block, whole = rest[:n], rest[n + 4 :]
            assert rest[n : n + 4] == b"\r\n\r\n"
            out.append((name, fields, block.partition(b"\r\n\r\n")[2]))
    return out


def test_a_plain_reader_finds_address_type_and_digest(spark, tmp_path):
    written(spark, tmp_path / "w")
    found = plain_records(tmp_path / "w")
    assert sorted(f["WARC-Target-URI"] for _, f, _ in found) == sorted(
        ["http://a/", "urn:x-page:1", "urn:x-page:1", "http://b/%0D%0AEvil:%201", "u", "u", "u", "u", "u", "%C3%A9", "%C3%A9"])
    assert all("X-Source-URI-Base64" in f for _, f, _ in found if "%" in f["WARC-Target-URI"])
    for _, fields, payload in found:
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()


def test_files_roll_within_a_shard_and_rows_without_a_key_are_spread(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i if i % 3 else None, f"http://h/{i}", "".join(rng.choice("abcdef ") for _ in range(900))) for i in range(240)]
    manifest = written(spark, tmp_path / "w", rows, file_bytes=5000, shard_bytes=40_000)
    by_shard = Counter(m.shard for m in manifest)
    assert len(by_shard) >= 6 and min(by_shard.values()) >= 2 and sum(m.records for m in manifest) == 240
    empty = [m for m in manifest if m.first_key is None]
    assert len({m.shard for m in empty}) >= 2 and max(m.shard for m in empty) < min(m.shard for m in manifest if m.first_key is not None)
    assert sum(m.records for m in empty) == 80
