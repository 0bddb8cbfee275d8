"""WARC archives: writing captures, and transaction assembly when reading them.

Each page becomes three records, tied by WARC-Concurrent-To: a request, the answer
(``response``, or ``revisit`` where another page holds the same payload) and
metadata. Files are written by Spark's own text writer, so they are committed like any
other output and live wherever Spark can write.

Reading parses the files by their Content-Length headers and joins requests,
answers and metadata through concurrent-to identifiers into one nested row per
capture; a revisit finds its response through WARC-Refers-To.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest
page_id is the response (null ids are smallest; among rows repeating that id, the last
one scanned), the others revisit it; smaller payloads are all responses.

Defined results: null html is the empty payload; null urls are written as ``about:blank``;
repeated rows are captures of their own; an empty table gives no captures. Line ends
inside urls are escaped. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_by_value

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in a file at most (three to a capture): keeps files near what one task reads well.
FILE_RECORDS = 12_000
DATE = "2024-01-31T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 letters."""
    hexed = F.sha1(payload)
    letters = []
    for g in range(8):
        value = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, uid, answer): ``answer`` is the uid of the response with the same payload."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\\s]", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("uid"),
    ).withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    # one partial aggregate per payload; only payloads that repeat are looked up again
    key = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63)).cast("bigint")), F.col("uid"))
    same = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("digest").agg(F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", F.col("last.uid").alias("answer"))
    )
    out = rows.join(same, "digest", "left")
    return out.withColumn("answer", F.when(F.octet_length("html") >= least_bytes, F.col("answer")))


def record_id(kind: str, uid: Column | str) -> Column:
    """A stable UUID URN of a record, from its kind and the capture's uid."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), F.col(uid) if isinstance(uid, str) else uid))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text, without the blank lines that end it (the writer's line separator adds them)."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    return F.concat(*lines, F.lit(CRLF), block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Archive every row of ``pages`` as ``*.warc`` text parts, gzipped, under ``path``."""
    c = captures(pages, least_bytes)
    revisit = F.col("answer").isNotNull() & (F.col("answer") != F.col("uid"))
    answer = record_id("answer", "uid")
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    request_block = F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Host: "), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.lit(CRLF + CRLF))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF))
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    http_type = [("Content-Type", F.lit("application/http"))]
    request = record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", "uid")), ("WARC-Concurrent-To", answer), *common, *http_type], request_block)
    response = record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", answer), *common, *digest, *http_type], F.concat(http, F.col("html")))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    refers = [("WARC-Profile", profile), ("WARC-Refers-To", record_id("answer", "answer"))]
    again = record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", answer), *common, *digest, *refers, *http_type], http)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF), F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit(CRLF))
    metadata = record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", "uid")), ("WARC-Concurrent-To", answer), *common, ("Content-Type", F.lit("application/warc-fields"))], fields)
    text = c.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    text.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


RECORD = {
    "warc_type": pa.string(), "record_id": pa.string(), "concurrent_to": pa.string(), "refers_to": pa.string(), "uri": pa.string(),
    "date": pa.string(), "digest": pa.string(), "payload_bytes": pa.int64(), "payload_sha1": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.string(),
}
RECORD_DDL = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, uri string, date string, digest string, "
    "payload_bytes bigint, payload_sha1 string, fields map<string,string>, payload string"
)


def inflate(data: bytes) -> bytes:
    """Content of a file that may be plain or any number of gzip members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record; only Content-Length decides where a block ends."""
    at, n = 0, len(data)
    while True:
        while at < n and data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= n:
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, block
        at = end + 4 + size


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per WARC record. ``payload=False`` leaves the payload's text out; its size and SHA-1 stay."""
    ship_by_value()
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * len(RECORD)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, RECORD.values())], names=list(RECORD))

        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse_records(inflate(content.as_py())):
                    kind = h.get("warc-type", "")
                    body, fields = block, None
                    if h.get("content-type", "").startswith("application/http"):
                        body = block.partition(b"\r\n\r\n")[2]
                    elif h.get("content-type", "").startswith("application/warc-fields"):
                        pairs = [x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x]
                        fields = [(k.strip(), v.strip()) for k, _, v in pairs]
                    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else None
                    text = body.decode("utf-8", "replace") if payload and kind == "response" else None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, len(body), sha1, fields, text))
                    if len(rows) == 2000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return files.mapInArrow(run, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, uri, date, request, answer, metadata).

    Requests and metadata are gathered under the answer that they are concurrent to; a
    capture holds three rows, so no group grows. Missing parts are null.
    """
    part = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    one = lambda *kinds: F.first(F.when(F.col("warc_type").isin(*kinds), F.struct(*[c for c in records.columns])), ignorenulls=True)
    return part.groupBy("capture_id").agg(
        F.first("uri", ignorenulls=True).alias("uri"), F.first("date", ignorenulls=True).alias("date"),
        one("request").alias("request"), one("response", "revisit").alias("answer"), one("metadata").alias("metadata"),
    )


def resolve_revisits(captured: DataFrame) -> DataFrame:
    """Adds ``original``: for a revisit the page and payload of the response that it refers to."""
    page = F.col("metadata.fields")["page-id"].try_cast("bigint")
    responses = captured.where("answer.warc_type = 'response'").select(
        F.col("capture_id").alias("_of"), F.struct(page.alias("page_id"), F.col("answer.payload_bytes").alias("payload_bytes"), F.col("answer.payload_sha1").alias("payload_sha1"), F.col("answer.payload").alias("payload")).alias("original")
    )
    revisits = captured.where("answer.warc_type = 'revisit'")
    found = revisits.join(responses, F.col("answer.refers_to") == F.col("_of"), "left").drop("_of")
    rest = captured.where("answer.warc_type = 'response'").withColumn("original", F.lit(None).cast(responses.schema["original"].dataType))
    return rest.unionByName(found)
