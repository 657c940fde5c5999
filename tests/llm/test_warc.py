"""WARC: written archives byte by byte, reading with cut records, assembly, odd rows."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from precis.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain_records(data: bytes) -> list[tuple[dict, bytes]]:
    """A plain reader: header, then as many bytes as it says, then the blank lines."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        out.append((fields, rest[:n]))
        assert rest[n:n + 4] == b"\r\n\r\n"
        data = rest[n + 4:]
    return out


def b32(payload: str) -> str:
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = html or ""
        again = len(body.encode()) >= least and first[body] != i
        out.append((i, len(body.encode()), b32(body), "revisit" if again else "response", first[body] if again else None))
    return sorted(out)


def got(df):
    return sorted((int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in df.collect())


NASTY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 999999\r\n\r\nb"
ROWS = [(7, "http://a.de/x?y#z", "é <p>"), (3, None, "é <p>"), (9, "no scheme", "é <p>"), (1, "http://b/\r\nEvil: 1", None),
        (2, "http://b", ""), (4, "http://c/", NASTY), (5, "http://c/", "\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/"),
        (6, "http://d/", "tail\r\n\r\n"), (8, "http://e/", "long " * 100_000), (10, "http://e/", NASTY)]


@pytest.mark.parametrize("least", [0, 6, 10**9])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert got(warc.round_trip(pages, least_bytes=least)) == expected(ROWS, least)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_byte_by_byte(spark, tmp_path, compression):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    warc.write_archives(pages, f"{tmp_path}/w", compression=compression)
    records = []
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        records += plain_records(gzip.decompress(data) if compression == "gzip" else data)
    assert len(records) == 3 * len(ROWS) and len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    by_type = {t: [(f, b) for f, b in records if f["WARC-Type"] == t] for t in ("request", "response", "revisit", "metadata")}
    mains = {f["WARC-Record-ID"] for f, _ in by_type["response"] + by_type["revisit"]}
    for kind in ("request", "metadata"):
        assert sorted(f["WARC-Concurrent-To"] for f, _ in by_type[kind]) == sorted(mains)
    for fields, block in by_type["response"]:
        assert fields["WARC-Payload-Digest"] == "sha1:" + b32(block.partition(b"\r\n\r\n")[2].decode())
    assert all(f["WARC-Refers-To"] in mains for f, _ in by_type["revisit"])
    read = {r.record_id: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    for fields, block in records:
        assert bytes(read[fields["WARC-Record-ID"]].block) == block


def test_splits_and_buffers(spark, tmp_path):
    """Records of every length around the reader's buffer, and splits that fall anywhere."""
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", rng.choice(["\r\n", "x\r\n\r\n", "WARC/", "é"]) * rng.randrange(0, 9000)) for i in range(120)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/w", compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        records = warc.read_archives(spark, f"{tmp_path}/w").where("type in ('response', 'revisit')").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.payload_bytes, r.payload_digest) for r in records) == sorted((len(h.encode()), b32(h)) for _, _, h in rows)


def record(kind, ident, to=(), block="", more=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id: {ident}", *[f"WARC-Concurrent-To: {t}" for t in to], *more,
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"


def test_assembly_in_either_direction(spark, tmp_path):
    http = ("Content-Type: application/http",)
    text = (record("warcinfo", "<i>") + record("request", "<q1>", ["<r1>"]) + record("response", "<r1>", block="H\r\n\r\nbody", more=http)
            + record("metadata", "<m1>", ["<q1>"], "about: 1") + record("response", "<r2>", ["<q2>", "<m2>"], "plain")
            + record("request", "<q2>") + record("metadata", "<m2>", block="about: 2") + record("metadata", "<m3>", ["<r1>"])
            + record("metadata", "<m4>", ["<nowhere>"]) + record("resource", "<r3>", block="x"))
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.warc.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "a/cut.warc").write_bytes(record("response", "<r4>", block="x" * 50)[:-30].encode())
    (tmp_path / "a/empty.warc").write_bytes(b"")
    records = warc.read_archives(spark, f"{tmp_path}/a").cache()
    rows = {r.capture.record_id: r for r in warc.assemble_captures(records).collect()}
    pairs = {k: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for k, r in rows.items()}
    assert pairs == {"<r1>": ("<q1>", "<m1>"), "<r2>": ("<q2>", "<m2>"), "<r3>": (None, None), "<r4>": (None, None)}
    assert rows["<r1>"].capture.payload_bytes == 4 and rows["<r2>"].capture.payload_digest == b32("plain")
    assert bytes(rows["<r4>"].capture.block) == b"x" * 24
    assert sorted(r.record_id for r in warc.left_over(records, warc.assemble_captures(records)).collect()) == ["<m3>", "<m4>"]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty).collect() == []
    rows = [(None, None, None, 1), (None, None, None, 1), (5, "http://a", "x", 1), (5, "http://a", "x", 1), (5, "http://a", "x", 2)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, _digest int").withColumn("type", F.lit("t"))
    out = sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(odd).collect())
    assert out == [("", 0, "response", None), ("", 0, "revisit", None), ("5", 1, "response", None), ("5", 1, "revisit", "5"),
                   ("5", 1, "revisit", "5")]


def test_a_large_group_of_copies(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"),
                                     F.when(F.col("id") % 3 < 2, F.lit("same")).otherwise(F.col("id").cast("string")).alias("html"))
    rows = warc.round_trip(pages).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r["record_type"], r["refers_to"], r["count"]) for r in rows if r["refers_to"]) == [("revisit", "0", 1999)]
    assert sum(r["count"] for r in rows) == 3000
