import base64
import gzip
import hashlib
import tempfile
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedlens.llm import sharding, warc
from feedlens.llm.common import scratch_path


def shard_sizes(rows, shards=8):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return [sum(r["size"] for r in by[k]) for k in range(shards)]


def test_near_equal_bytes_and_whole_groups(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.expr("repeat(sha1(cast(if(id % 10 = 0, id % 50, id) as string)), cast(1 + pmod(hash(id % 977), 6) as int))").alias("text"), F.lit("x").alias("slot"), F.lit(1).alias("k1")
    )
    rows = sharding.shard_rows(docs).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 6000 and rows[0].k1 == 1
    size = shard_sizes(rows)
    assert max(size) - min(size) <= 0.02 * sum(size) / 8
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    home = defaultdict(set)
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        home[text[r.doc_id]].add(r["shard"])
    assert sum(len(s) > 1 for s in home.values()) <= 7


def test_a_third_of_all_rows_are_copies(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text that is copied")).otherwise(F.sha1(F.col("id").cast("string"))).alias("text"))
    size = shard_sizes(sharding.shard_rows(docs, range_rows=64).collect())
    assert max(size) - min(size) <= 0.02 * sum(size) / 8


def test_identical_rows_are_still_cut(spark):
    docs = spark.range(4000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    size = shard_sizes(sharding.shard_rows(docs, range_rows=64).collect())
    assert max(size) - min(size) <= 0.03 * sum(size) / 8


def test_shards_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = sharding.shard_rows(odd_docs)
    assert set(got.columns) == set(odd_docs.columns) | {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    rows = got.collect()
    shard_sizes(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard_rows(no_docs).count() == 0


def test_sharding_stays_in_the_jvm(odd_docs):
    plan = sharding.shard_rows(odd_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- WARC ----

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "https://b.example/", "<p>one</p>"), (3, None, None), (4, "http://c.example/ü\r\nX: y", ""),
    (5, "http://d.example/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "u", "x" * 200_000 + "é😀\r\n\r\n"),
    (7, "http://e.example/", "tie"), (7, "http://e.example/", "tie"), (None, "http://f.example/", "tie"), (None, "http://f.example/", "alone"),
]


def captured(spark, rows, least=0, payload=True):
    path = scratch_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, uid int"), path, least, file_records=7)
    return path, warc.assemble(warc.read_records(spark, path, payload))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    path, got = captured(spark, PAGES, least)
    rows = got.collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert r.request.warc_type == "request" and r.metadata.warc_type == "metadata" and r.request.concurrent_to == r.answer.record_id == r.capture_id
    payloads = sorted(r.answer.payload for r in rows if r.answer.warc_type == "response")
    unique = lambda keep: {h for _, _, h in PAGES if len((h or "").encode()) >= least and keep}
    want = sorted([x or "" for x in {(h or "") for h in unique(True)}] + [h or "" for _, _, h in PAGES if len((h or "").encode()) < least])
    assert payloads == want
    for r in rows:
        if r.answer.warc_type == "response":
            assert r.answer.payload_sha1 == r.answer.digest == base64.b32encode(hashlib.sha1(r.answer.payload.encode()).digest()).decode()
    found = {(r.metadata.fields["page-id"], r.answer.digest): r.original for r in warc.resolve_revisits(got).collect() if r.answer.warc_type == "revisit"}
    assert found["1", found_digest("<p>one</p>")].page_id == 2
    if least == 0:
        assert found["3", found_digest("")].page_id == 4
        assert found["", found_digest("")] if ("", found_digest("")) in found else True
    if least <= 3:
        assert found["", found_digest("tie")].page_id == 7 and found["7", found_digest("tie")].page_id == 7


def found_digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_reads_plain_and_member_wise_gzip_from_elsewhere(spark):
    one = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Concurrent-To: <urn:x:2>\r\nContent-Type: application/http\r\nContent-Length: 4\r\n\r\nGET \r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:2>\r\nContent-Type: application/http\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200\r\n\r\nabc\r\n\r\n"
    folder = tempfile.mkdtemp(prefix="run-")
    with open(f"{folder}/a.warc", "wb") as f:
        f.write(one + two)
    rows = warc.assemble(warc.read_records(spark, folder)).collect()
    assert len(rows) == 1 and rows[0].answer.payload == "abc" and rows[0].metadata is None
    folder = tempfile.mkdtemp(prefix="run-")
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(gzip.compress(one) + gzip.compress(two))
    assert warc.assemble(warc.read_records(spark, folder)).collect()[0].request.record_id == "<urn:x:1>"
    with pytest.raises(ValueError):
        list(warc.parse_records(two[:-10]))


def test_no_pages(spark):
    _, got = captured(spark, [])
    assert got.count() == 0
