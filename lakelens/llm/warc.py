"""WARC archives: writing captures, reading records back, assembling transactions.

Records are written by Spark's text writer, a record per row: a record ends with two
CRLFs, which are the writer's row separator. Files are compressed whole, so that one
task reads one file from its beginning, as a stream of pieces between version lines;
a payload that itself holds a version line is put together again by its length.
Neither side opens a file outside Spark's readers and writers, and no more than one
record is held at a time.

A capture is a response or revisit record with the request and metadata records that
name it as concurrent, joined through those identifiers.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.session import stage

_VERSION = "WARC/1.0\r\n"
_CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: 160 bits are 32 letters."""
    bits = F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        # 10 hexadecimal digits at a time: 40 bits, 8 letters
        lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), i * 10 + 1, F.lit(10)), 16, 32), 8, "0")), "")
    return F.translate(bits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _uuid(*parts: Column) -> Column:
    name = F.md5(F.concat_ws("|", *parts).cast("binary"))
    pieces = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: str, record_id: Column, block: Column, block_type: str, url: Column | None, *more: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    head = [F.lit(_VERSION), F.lit(f"WARC-Type: {kind}{_CRLF}"), line("WARC-Record-ID", record_id),
            F.lit(f"WARC-Date: {_DATE}{_CRLF}")]
    if url is not None:
        # a URL with line ends in it would end the header
        head.append(line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")))
    head += [F.coalesce(m, F.lit("")) for m in more]
    head += [F.lit(f"Content-Type: {block_type}{_CRLF}"),
             line("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(*head, F.lit(_CRLF), block)


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per page: its row, payload (html, null is empty), digest and, for a revisit,
    ``ref`` with row and page_id of the response it repeats.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest
    page_id is the response; equal ids are told apart by their row, null ids are
    smallest. Only digests that come twice are joined back.
    """
    source = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    source = source.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    enough = F.octet_length("html") >= least
    groups = (
        source.where(enough).groupBy("digest")
        .agg(F.max(F.struct("page_id", "row")).alias("ref"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("digest", "ref")
    )
    out = source.join(groups, "digest", "left")
    same = ~enough | F.col("ref").isNull() | (F.col("ref.row") == F.col("row"))
    return out.withColumn("ref", F.when(~same, F.col("ref")))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """A capture per page: response or revisit, request and metadata records."""
    crlf = F.lit(_CRLF)
    rows = planned(pages, least)
    capture = _uuid(F.lit("capture"), F.col("row").cast("string"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
                    F.octet_length("html").cast("string"), crlf, crlf)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), crlf)
    url = F.col("url")
    asked = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    response = _record("response", capture, F.concat(http, F.col("html")), "application/http; msgtype=response", url, digest)
    refers = F.concat(F.lit("WARC-Refers-To: "), _uuid(F.lit("capture"), F.col("ref.row").cast("string")), crlf)
    revisit = _record("revisit", capture, http, "application/http; msgtype=response", url, digest,
                      F.lit(f"WARC-Profile: {_PROFILE}{_CRLF}"), refers)
    with_it = F.concat(F.lit("WARC-Concurrent-To: "), capture, crlf)
    request = _record("request", _uuid(F.lit("request"), F.col("row").cast("string")),
                      F.concat(F.lit("GET "), asked, F.lit(f" HTTP/1.1{_CRLF}Accept: text/html{_CRLF}{_CRLF}")),
                      "application/http; msgtype=request", url, with_it)
    metadata = _record("metadata", _uuid(F.lit("metadata"), F.col("row").cast("string")),
                       F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), crlf),
                       "application/warc-fields", url, with_it)
    captured = F.when(F.col("ref").isNull(), response).otherwise(revisit)
    (rows.select(F.explode(F.array(request, captured, metadata)).alias("value"))
     .write.option("lineSep", _CRLF * 2).option("compression", "gzip").text(path))


_RECORD = ("record_id string, type string, concurrent_to array<string>, refers_to string, url string, "
           "declared_digest string, http_head string, payload binary, payload_bytes bigint, payload_digest string")


class _Parser:
    """Records from pieces of a file that were cut at every version line."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.file = None
        self.open: bytes | None = None  # a record whose block is not complete yet
        self.needed = 0

    def feed(self, file: str, piece: bytes) -> None:
        if file != self.file:
            self.flush()
            self.file = file
        if self.open is not None:
            self.open += _VERSION.encode() + piece
        elif piece:
            self.open = piece
            head, found, _ = piece.partition(b"\r\n\r\n")
            self.needed = len(head) + 4 + int(_fields(head).get("content-length", ["0"])[0]) if found else 0
        if self.open is not None and len(self.open) >= self.needed:
            self.flush()

    def flush(self) -> None:
        if self.open is not None:
            self.rows.append(_parsed(self.open[:self.needed] if self.needed else self.open))
        self.open = None


def _fields(head: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, found, value = line.partition(":")
        if found:
            out.setdefault(name.strip().lower(), []).append(value.strip())
    return out


def _parsed(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    one = lambda name: fields.get(name, [None])[0]
    kind, http, payload, size, digest = one("warc-type"), None, block, None, None
    if (one("content-type") or "").startswith("application/http"):
        top, found, payload = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
        if not found:
            payload = b""
    declared = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind == "revisit":  # the payload is another record's; its size is in the HTTP header
        length = _fields((http or "").encode()).get("content-length")
        size, digest, payload = int(length[0]) if length and length[0].isdigit() else None, declared, None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (one("warc-record-id"), kind, fields.get("warc-concurrent-to", []), one("warc-refers-to"),
            one("warc-target-uri"), declared, http, payload, size, digest)


_ARROW = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(),
          pa.binary(), pa.int64(), pa.string())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), _ARROW)], names=names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser, held = _Parser(), 0
    for batch in batches:
        for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece")):
            parser.feed(file, piece.as_py())
            held += len(piece.as_buffer() or b"")
            if parser.rows and (held > 1 << 22 or len(parser.rows) >= 4000):
                yield _batch(parser.rows)
                parser.rows, held = [], 0
    parser.flush()
    if parser.rows:
        yield _batch(parser.rows)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the compressed archives under ``path``."""
    pieces = spark.read.option("lineSep", _VERSION).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_read, _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: the record, its request, its metadata.

    A request or metadata record belongs to the capture it names as concurrent, or
    that names it. Where several of a kind do, the one with the smallest record id
    is shown and ``n_requests`` and ``n_metadata`` say how many there are; a capture
    without any has null. Requests of no capture give no row.
    """
    main = records.where("type IN ('response', 'revisit')")
    side = records.where("type IN ('request', 'metadata')")
    named = side.select("record_id", F.explode("concurrent_to").alias("capture"))
    names = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    known = side.select("record_id", "type", "url", "http_head", "payload")
    # captures that name their requests are the other way round
    link = named.unionByName(names).distinct()
    part = F.struct("record_id", "url", "http_head", "payload")
    is_request = F.col("type") == "request"
    grouped = link.join(known, "record_id").groupBy("capture").agg(
        F.min_by(F.when(is_request, part), F.when(is_request, F.col("record_id"))).alias("request"),
        F.count_if(is_request).alias("n_requests"),
        F.min_by(F.when(~is_request, part), F.when(~is_request, F.col("record_id"))).alias("metadata"),
        F.count_if(~is_request).alias("n_metadata"),
    ).withColumnRenamed("capture", "record_id")
    return main.join(grouped, "record_id", "left").select(
        "record_id", F.col("type").alias("record_type"), "url", "refers_to", "payload", "payload_bytes",
        "payload_digest", "declared_digest", "http_head", "request", "metadata",
        F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def page_captures(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes the pages' archives to ``path``, reads them back and gives a row per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, null url an empty one, a null page_id stays null.
    Repeated rows are captures of their own. Columns other than page_id, url and html
    are not read. An empty table writes empty archives and gives no rows.
    """
    write(pages, path, least)
    read = records(pages.sparkSession, path)
    # parsed once: of the payloads only metadata is needed from here on
    read = captures(stage(read.withColumn("payload", F.when(F.col("type") == "metadata", F.col("payload")))
                          .withColumn("http_head", F.lit(None).cast("string"))))
    page = F.regexp_extract(F.decode("metadata.payload", "UTF-8"), r"pageId: (-?\d+)", 1)
    rows = read.select("record_id", page.try_cast("bigint").alias("page_id"),
                       "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("ref"))
    named = rows.select(F.col("record_id").alias("ref"), F.col("page_id").alias("refers_to"))
    again = rows.where("ref IS NOT NULL")
    known = again.join(named.join(again.select("ref").distinct(), "ref"), "ref", "left")
    first = rows.where("ref IS NULL").withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(*columns).unionByName(known.select(*columns))
