"""WARC archives: writing captures, reading records, assembling transactions.

Writing: a capture is a transaction of three records, a request, a response (or a
revisit of an equal payload) and metadata, tied by ``WARC-Concurrent-To``. Records
are rows of Spark's text sink, whose line separator is the blank lines that end a
record, so each task writes its own archive. Payloads are never shuffled to find
equal ones: digests are grouped, and the digests that occur more than once reach
the writing scan as a bitmap. Of those payloads one a task is sent on; revisits
carry no payload and come from the narrow rows.

Reading: archives are cut at every end of a record that a version line follows.
A payload may hold such a place too, so each piece is held against its
``Content-Length``; pieces that fall short are joined with the ones after them, in
a stream over the lengths alone. Nothing but one record is held at a time.

Assembly: request and metadata records meet their capture by the identifiers they
are concurrent to (either side may name the other, and metadata may name the
request), and every capture becomes one nested row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm.common import bits_for, key_bitmap, maybe_in, quoted
from precis.operators.ids import join_per_group
from precis.session import shared_path, written
from precis.sources.files import with_file_positions

#: Fixed values of the format: line end, end of a header, end of a record before the next version line.
EOL, BLANK, CUT = "\r\n", "\r\n\r\n", "\r\n\r\nWARC/"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Types of the records that are captures; requests and metadata belong to one.
CAPTURES = ("response", "revisit", "resource")
#: The pages say no time of capture: all records bear this one unless told otherwise.
DATE = "2000-01-01T00:00:00Z"

_SAME = ["_digest", "_bytes", "_check"]


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32, as ``WARC-Payload-Digest`` has it: 10 hex digits are 8 of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(*parts: Column | str) -> Column:
    """A record's name, the same whenever it is made from the same parts."""
    h = F.md5(F.to_json(F.struct(*[(F.lit(p) if isinstance(p, str) else p).cast("string").alias(f"p{i}")
                                   for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in
                                                           ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: Column | str, ident: Column, fields: list[tuple[str, Column | str]], block: Column, date: str) -> Column:
    """Header and block of a record; the sink writes the blank lines after it. Null fields are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *fields,
            ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value) for name, value in head]
    return F.concat(F.concat_ws(EOL, F.lit(VERSION), *lines), F.lit(BLANK), block)


def _captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(``_id``, ``_url``, ``_digest``, ``_bytes``, ``_main`` record id, ``_of`` record id and ``_of_url`` of
    the response that a revisit refers to, ``_payload``, null for revisits)."""
    body = F.coalesce(quoted(payload_col), F.lit(""))
    rows = pages.select(quoted(id_col).alias("_id"), quoted(url_col).cast("string").alias("_url"), body.alias("_payload"),
                        payload_digest(body).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"),
                        F.xxhash64(body).alias("_check"))
    first = [F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_url").isNull().alias("no_url"), F.col("_url")]
    # written once: the row numbers tell repeated rows apart and stay what they are
    marks = written(rows.drop("_payload").withColumn("_row", F.monotonically_increasing_id()), "warc-marks")
    groups = marks.where(F.col("_bytes") >= least_bytes).groupBy(*_SAME).agg(
        F.min(F.struct(*first, "_row")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1").drop("n"), "warc-copies")
    copies = groups.count()
    none = F.lit(None).cast("string")

    def response(frame: DataFrame) -> DataFrame:
        return frame.select("_id", "_url", "_digest", "_bytes", _record_id("response", F.col("_digest"), F.col("_id"), F.col("_url"))
                            .alias("_main"), none.alias("_of"), none.alias("_of_url"), "_payload")

    if not copies:
        return response(rows)
    bits = bits_for(copies)
    marked = maybe_in(rows, "_check", key_bitmap(groups, "_check", bits), bits, "_again")
    again = F.col("_again") & (F.col("_bytes") >= least_bytes)
    # equal payloads are one after a task has seen them, however many rows have them
    chosen = marked.where(again).groupBy(*_SAME).agg(F.min(F.struct(*first)).alias("f"), F.first("_payload").alias("_payload"))
    chosen = chosen.select("f._id", "f._url", "_payload", *_SAME)
    same = marks.join(groups, _SAME).where("_row <> first._row")
    revisits = same.select(
        "_id", "_url", "_digest", "_bytes", _record_id("revisit", F.col("_digest"), F.col("_id"), F.col("_url"), F.col("_row")).alias("_main"),
        _record_id("response", F.col("_digest"), F.col("first._id"), F.col("first._url")).alias("_of"),
        F.col("first._url").alias("_of_url"), none.alias("_payload"))
    return response(marked.where(~again).drop("_again")).unionByName(response(chosen)).unionByName(revisits)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_bytes: int = 0, date: str = DATE, compression: str = "gzip") -> None:
    """A request, a response or revisit, and a metadata record for every row of ``pages``, in archives under ``path``.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the
    smallest id (a null id after all others; equal ids: the smallest url; repeated
    rows: one) is the response and the others revisit it; smaller payloads are all
    responses. A null payload is empty, a null url leaves its fields out, and line
    breaks in a url are written as %0D and %0A. The id is a field of the metadata
    record (none for a null id). Very long payloads are one record each. An empty
    table writes archives without a record; other columns are not read. Each task
    writes one archive, compressed as one member (``compression="none"``: plain,
    which can be read in splits)."""
    rows = _captures(pages, id_col, url_col, payload_col, least_bytes)
    url = _one_line(F.col("_url"))
    host = F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://[^/?#]*|#.*$", "")
    asked = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)),
                     F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(host, F.lit("")), F.lit(BLANK))
    got = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                   F.col("_bytes").cast("string"), F.lit(BLANK), F.coalesce("_payload", F.lit("")))
    about = F.coalesce(F.concat(F.lit("capture-id: "), F.url_encode(F.col("_id").cast("string")), F.lit(EOL)), F.lit(""))
    revisit = F.col("_payload").isNull()
    page = [("WARC-Target-URI", url)]
    with_main = [("WARC-Concurrent-To", F.col("_main")), *page]
    records = F.array(
        _record("request", _record_id("request", F.col("_main")), [*with_main, ("Content-Type", "application/http;msgtype=request")],
                asked, date),
        _record(F.when(revisit, "revisit").otherwise("response"), F.col("_main"),
                [*page, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")), ("WARC-Profile", F.when(revisit, PROFILE)),
                 ("WARC-Refers-To", F.col("_of")), ("WARC-Refers-To-Target-URI", _one_line(F.col("_of_url"))),
                 ("Content-Type", "application/http;msgtype=response")], got, date),
        _record("metadata", _record_id("metadata", F.col("_main")), [*with_main, ("Content-Type", "application/warc-fields")],
                about, date))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", BLANK).option("compression", compression).text(path)


# ------------------------------------------------------------------------------------------ reading

def _head(value: Column) -> Column:
    return F.substring_index(value, BLANK, 1)


def _field(head: Column, name: str) -> Column:
    """A field of a header, null where it has none (names in any case)."""
    found = F.regexp_extract(head, rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def _needed(value: Column, head: Column) -> Column:
    """Bytes of a record up to the end of its block; null without a length."""
    length = F.regexp_extract(head, r"(?i)\ncontent-length:[ \t]*([0-9]{1,10})[ \t]*(?:\r|$)", 1)
    return F.when(length != "", F.octet_length(head) + len(BLANK) + length.cast("long"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of records that were cut: (file, line, line of the record's first piece). The pieces
    come sorted by file and place; all that is kept is what the open record still wants."""
    file, line, start, wanted = None, 0, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for name, has, need in zip(*[c.to_pylist() for c in batch.columns]):
            if name != file:
                file, line, wanted = name, 0, 0
            if wanted > 0:
                out.append((name, line, start))
                wanted -= len(CUT) + has
            elif need is not None and has < need:
                start, wanted = line, need - has
                out.append((name, line, start))
            line += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in
                                          enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "line", "start"])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): one row per record, as its bytes from the version line on."""
    raw = spark.read.option("lineSep", CUT).text(path)
    value = F.col("value")
    lengths = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_mono"), F.octet_length(value).cast("long").alias("has"),
                         _needed(value, _head(value)).alias("need"))
    lengths = written(lengths, "warc-lengths")
    if lengths.where("has < need").isEmpty():
        return raw.select(F.col("_metadata.file_path").alias("file"), "value")
    place = ["file", "_block", "_mono"]
    parts = lengths.repartition("file").sortWithinPartitions(*place).select("file", "has", "need").mapInArrow(
        _parts, "file string, line long, start long")
    pieces = join_per_group(with_file_positions(raw), parts, ["file", "line"], salt_from=[F.col("line")], how="left")
    pieces = written(pieces, "warc-pieces")
    alone = pieces.where("start is null").select("file", "value")
    # one group is one record
    glued = pieces.where("start is not null").groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda p: p["value"]), CUT).alias("value"))
    return alone.unionByName(glued.select("file", "value"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path`` (plain or .gz): file, ``record_id``, ``type``,
    ``target_uri``, ``date``, ``concurrent_to`` (a list), ``refers_to``, ``payload_bytes``,
    ``payload_digest`` and ``block`` (binary).

    Length and digest of a response are those of the payload itself, after the
    header of its HTTP message; of a revisit, which has none, those it states.
    Absent fields are null, and so is the type of a piece that is no record (its
    bytes are the block). A block shorter than its length (a truncated archive) is
    returned as far as it goes. Empty archives give no rows; records that occur
    twice are returned twice."""
    value = F.col("value")
    rows = _whole(spark, path).withColumn("head", _head(value)).withColumn("need", _needed(value, F.col("head")))
    head = F.col("head")
    start = F.octet_length(head) + len(BLANK)
    rows = rows.where(F.length(F.trim(F.translate(value, EOL, "  "))) > 0).select(
        "file", _field(head, "warc-record-id").alias("record_id"), F.lower(_field(head, "warc-type")).alias("type"),
        _field(head, "warc-target-uri").alias("target_uri"), _field(head, "warc-date").alias("date"),
        F.regexp_extract_all(head, F.lit(r"(?i)\nwarc-concurrent-to:[ \t]*([^\r\n]*[^\r\n \t])"), 1).alias("concurrent_to"),
        _field(head, "warc-refers-to").alias("refers_to"), _field(head, "warc-payload-digest").alias("stated"),
        F.lower(F.coalesce(_field(head, "content-type"), F.lit(""))).startswith("application/http").alias("http"),
        F.when(F.col("need").isNull(), value.cast("binary")).otherwise(
            F.substring(value.cast("binary"), start + 1, (F.col("need") - start).cast("int"))).alias("block"))
    message = F.substring_index(F.col("block").cast("string"), BLANK, 1)
    after = F.octet_length(message) + len(BLANK)
    size = F.octet_length("block")
    payload = F.when(~F.col("http"), F.col("block")).otherwise(
        F.substring(F.col("block"), after + 1, F.greatest(size - after, F.lit(0))))
    told = F.regexp_extract(message, r"(?i)\ncontent-length:[ \t]*([0-9]{1,18})", 1)
    revisit = F.col("type") == "revisit"
    capture = F.col("type").isin(*CAPTURES)
    return rows.withColumn("payload", F.when(capture & ~revisit, payload)).select(
        "file", "record_id", "type", "target_uri", "date", "concurrent_to", "refers_to",
        F.when(revisit, F.when(told != "", told.cast("long"))).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated", "^[^:]*:", "")).otherwise(payload_digest(F.col("payload"))).alias("payload_digest"),
        "block")


# ------------------------------------------------------------------------------------------ assembly

def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture of ``records`` (as ``read_archives`` gives them; pass a stored
    table): ``capture``, ``request`` and ``metadata`` structs, the latter with record_id and block.

    A request or metadata record belongs to a capture if it is concurrent to it, if
    the capture is concurrent to it, or (metadata) if it is concurrent to a request
    of the capture. Of several, the one with the smallest record id is taken;
    ``left_over`` gives the rest. Without one the struct is null. Captures whose
    record id is null, or occurs again, are rows of their own. Records of other
    types, of null type and extra columns are not read; no records give no rows.

    Requests and metadata are reduced to one a capture before they meet it, so a
    capture that many records name is no large join, and that reduction starts in the
    tasks that read."""
    capture = F.col("type").isin(*CAPTURES)
    main = records.where(capture)
    side = records.where(F.col("type").isin("request", "metadata") & F.col("record_id").isNotNull()).select(
        "record_id", "type", "block", "concurrent_to")
    direct = side.select("record_id", "type", "block", F.explode("concurrent_to").alias("of"))
    named = main.where("record_id is not null").select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("of"))
    back = side.drop("concurrent_to").join(written(named.groupBy("record_id").agg(F.min("of").alias("of")), "warc-named"), "record_id")
    of_request = direct.where("type = 'request'").select("record_id", "of").unionByName(
        back.where("type = 'request'").select("record_id", "of")).groupBy("record_id").agg(F.min("of").alias("main"))
    of_request = written(of_request.withColumnRenamed("record_id", "of"), "warc-requests")
    over = direct.where("type = 'metadata'").join(of_request, "of").select("record_id", "type", "block", F.col("main").alias("of"))
    both = direct.unionByName(back.select(*direct.columns)).unionByName(over)

    def least(kind: str) -> Column:
        return F.min(F.when(F.col("type") == kind, F.struct("record_id", "block"))).alias(kind)

    partners = written(both.groupBy("of").agg(least("request"), least("metadata")), "warc-partners")
    held = main.select(F.struct(*[c for c in ("record_id", "type", "target_uri", "date", "refers_to", "payload_bytes",
                                              "payload_digest", "block")]).alias("capture"))
    return held.join(partners, F.col("capture.record_id") == F.col("of"), "left").select("capture", "request", "metadata")


def left_over(records: DataFrame, captures: DataFrame) -> DataFrame:
    """The request and metadata records that no row of ``captures`` holds."""
    used = captures.select(F.explode(F.array("request.record_id", "metadata.record_id")).alias("record_id")).distinct()
    return records.where(F.col("type").isin("request", "metadata")).join(used, "record_id", "left_anti")


def capture_id(metadata: Column) -> Column:
    """The id that ``write_archives`` put into the metadata record; null without one."""
    found = F.regexp_extract(metadata["block"].cast("string"), r"(?:^|\n)capture-id: ([^\r\n]*)", 1)
    return F.when(F.regexp_like(metadata["block"].cast("string"), F.lit(r"(?:^|\n)capture-id: ")), F.url_decode(found))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least_bytes: int = 0) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back: one row per row with the id (as text),
    ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``, the id of the response
    that a revisit refers to (else null). Odd rows as in ``write_archives``."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, least_bytes)
    # blocks of captures are not wanted any more
    small = F.when(F.col("type").isin(*CAPTURES), F.lit(None).cast("binary")).otherwise(F.col("block"))
    records = written(read_archives(spark, path).withColumn("block", small), "warc-records")
    captures = assemble_captures(records).select(
        capture_id(F.col("metadata")).alias("_id"), "capture.record_id", "capture.refers_to", "capture.type",
        "capture.payload_bytes", "capture.payload_digest")
    captures = written(captures, "warc-captures")
    originals = captures.where("type = 'response'").groupBy(F.col("record_id").alias("_of")).agg(F.min("_id").alias("_first"))
    originals = written(originals, "warc-originals")
    out = captures.where("refers_to is null").withColumn("_first", F.lit(None).cast("string")).unionByName(
        captures.where("refers_to is not null").join(originals, F.col("refers_to") == F.col("_of"), "left").drop("_of"))
    return out.select(F.col("_id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                      F.col("_first").alias("refers_to"))
