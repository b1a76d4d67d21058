"""WARC archives: writing captures with revisit records, reading archives, and assembling transactions.

A capture is three records: a request, a response (or a revisit, where an equal payload is stored elsewhere) and a
metadata record; request and metadata name the response by WARC-Concurrent-To. Writing goes through Spark's text sink
(a record ends in CR LF CR LF, the last LF being the line separator), so the commit protocol and any file system that
Spark knows are kept. Reading parses each archive file as a stream.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The digits of base 32 as Java's conv() and as RFC 4648 write them.
_CONV, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2024-01-01T00:00:00Z"
#: Rows of an archive file, and bytes of payloads, so that a file stays of a size that one task reads; it's read whole.
FILE_ROWS, FILE_BYTES = 20_000, 256 << 20


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV, _RFC)


def _uuid(key: Column) -> Column:
    h = F.md5(key.cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _record(kind: Column | str, ident: Column, block: Column, content_type: str, *more: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), ident, F.lit(">")), F.lit(f"WARC-Date: {_DATE}")]
    lines += [*more, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, record_type, refers_to) of each page.

    Of the rows whose payloads are equal and of min_bytes at least, that with the largest page_id is the response, others
    revisit it; smaller payloads are all responses. A null html is the empty payload. Repeated rows of the largest page_id
    are all responses; a group whose page_ids are all null consists of responses.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), base32_sha1(payload.cast("binary")).alias("digest"))
    last = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"))
    rows = rows.join(last, "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select(
        "page_id", "url", "payload", "n_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to")
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes one capture per row of pages (page_id, url, html) to gzip archives under path.

    Control characters and blanks in a URL are written as %20, a null URL as about:blank; an empty table writes archives
    without records. Extra columns are ignored. A file has no more than FILE_ROWS captures, and fewer where a payload is so
    long that FILE_BYTES could be passed; a payload longer than that has a file of its own.
    """
    longest = pages.agg(F.max(F.octet_length(F.coalesce("html", F.lit("")))).alias("n")).first()["n"] or 0
    most = max(1, min(FILE_ROWS, FILE_BYTES // max(longest, 1)))
    rows = plan(pages, min_bytes)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))

    def ident(what: str, page: Column) -> Column:
        return _uuid(F.concat_ws("|", F.lit(what), page, F.col("digest")))

    main = ident("response", name)
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    target = F.concat(F.lit("WARC-Target-URI: "), uri)
    beside = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), main, F.lit(">"))
    refers = F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), ident("response", F.col("refers_to").cast("string")), F.lit(">")))
    profile = F.when(F.col("refers_to").isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("record_type") == "response", F.concat(head, F.col("payload"))).otherwise(head)
    capture = _record(F.col("record_type"), main, body, "application/http; msgtype=response", target, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), refers, profile)
    asked = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    request = _record("request", ident("request", name), asked, "application/http; msgtype=request", target, beside)
    facts = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.lit(""))
    metadata = _record("metadata", ident("metadata", name), facts, "application/warc-fields", target, beside)
    whole = F.concat(request, capture, metadata)
    text = rows.select(F.substring(whole, F.lit(1), F.length(whole) - 1).alias("value"))
    text.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(stream: io.BufferedIOBase):
    """(headers in lower case, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield headers, block


_FIELDS = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to_id", pa.string()), ("uri", pa.string()), ("declared_digest", pa.string()),
    ("http_head", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
]
_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to_id string, uri string, declared_digest string, http_head string, payload_bytes long, payload_digest string, fields map<string,string>"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives (.warc, or gzip of any number of members) under path.

    HTTP blocks are split into head and payload, whose length and digest are computed from the bytes read; warc-fields
    blocks give a map. A file is read whole by one task (below 2 GB as it lies there) and unpacked record by record; a
    damaged one raises ValueError.
    """
    schema = _SCHEMA + (", payload binary" if with_payload else "")
    fields = _FIELDS if with_payload else _FIELDS[:-1]
    arrow = pa.schema([pa.field(n, t) for n, t in fields])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = io.BytesIO(content.as_buffer())
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if zipped else raw
                rows, held = [], 0
                for headers, block in parse(stream):
                    kind, row = headers.get("content-type", ""), {}
                    if kind.startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        row = {"http_head": head.decode("utf-8", "replace"), "payload_bytes": len(payload), "payload_digest": _b32(payload)}
                        if with_payload:
                            row["payload"] = payload
                            held += len(payload)
                    elif kind.startswith("application/warc-fields"):
                        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x)
                        row = {"fields": [(k.strip(), v.strip()) for k, _, v in pairs]}
                    rows.append(row | {
                        "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to_id": headers.get("warc-refers-to"),
                        "uri": headers.get("warc-target-uri"), "declared_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    })
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with request and metadata found by their concurrent-to id, and of a revisit the response that it refers to.

    A capture that lacks a request, metadata or what it refers to keeps null there; of several, any one is taken (a repeated
    capture repeats them alike); requests and metadata that name no capture are left out. Repeated responses stay repeated.
    """
    record = F.struct(*[c for c in records.columns if c not in ("concurrent_to", "record_id")])

    def beside(kind: str) -> DataFrame:
        mine = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        kept = F.struct("record_id", "uri", "http_head", "fields")
        return mine.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.first(kept).alias(kind))

    main = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), record.alias("response"))
    whole = main.join(beside("request"), "capture_id", "left").join(beside("metadata"), "capture_id", "left")
    first = whole.where("response.record_type = 'response'").groupBy(F.col("capture_id").alias("_refers")).agg(
        F.first(F.struct(F.col("metadata.fields").alias("fields"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"))).alias("referred")
    )
    # what refers to nothing is dealt by its own id
    return whole.withColumn("_refers", F.coalesce("response.refers_to_id", "capture_id")).join(first, "_refers", "left").withColumn("referred", F.when(F.col("response.record_type") == "revisit", F.col("referred"))).drop("_refers")


def digest(captures: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to; of the full payload, which for revisits is that of the response referred to."""
    r = F.col("response")
    revisit = r["record_type"] == "revisit"
    return captures.select(
        F.col("metadata.fields")["pageId"].cast("long").alias("page_id"),
        F.when(revisit, F.col("referred.payload_bytes")).otherwise(r["payload_bytes"]).alias("payload_bytes"),
        F.when(revisit, F.col("referred.payload_digest")).otherwise(r["payload_digest"]).alias("payload_digest"),
        r["record_type"].alias("record_type"),
        F.when(revisit, F.col("referred.fields")["pageId"].cast("long")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""
