"""Source readers on small landed files (SRC1–SRC8)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from feedlens.sources import feeds as S

NOW = "2024-01-31 00:00:00"
CUTOFF = "2024-01-20 00:00:00"


def _dir():
    return tempfile.mkdtemp(prefix="feedlens-src-")


def test_rss_xml(spark):
    d = _dir()
    with open(os.path.join(d, "feed.xml"), "w") as f:
        f.write("""<?xml version="1.0"?><rss><channel>
<item><title> Big &amp; bad CVE-2024-1111 </title><link>https://a.com/1</link>
<pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Hello   &lt;b&gt;world&lt;/b&gt;&lt;/p&gt;</description></item>
<item><title>Old</title><link>https://a.com/2</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Unsafe</title><link>ftp://a.com/3</link><pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title></title><link>https://a.com/4</link></item>
<item><title>No date</title><link>https://a.com/5</link></item>
</channel></rss>""")
    items = S.rss_items(S.read_rss(spark, d, "item"), "Feed", "blogs", 1, CUTOFF, NOW).orderBy("url").collect()
    assert [r.url for r in items] == ["https://a.com/1", "https://a.com/5"]
    assert items[0].title == "Big & bad CVE-2024-1111" and items[0].description == "Hello world"
    assert items[0].cve_ids == ["CVE-2024-1111"]
    assert str(items[1].published) == "2024-01-31 00:00:00"


def test_nvd_json(spark):
    d = _dir()
    doc = {"vulnerabilities": [
        {"cve": {"id": "CVE-2024-0001", "published": "2024-01-29T10:00:00.000",
                 "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "x" * 90}],
                 "metrics": {"cvssMetricV31": [], "cvssMetricV30": [{"cvssData": {"baseScore": 7.5}}]}}},
        {"cve": {"id": "CVE-2024-0002", "published": "bad", "descriptions": [], "metrics": {}}},
    ]}
    with open(os.path.join(d, "nvd.json"), "w") as f:
        json.dump(doc, f)
    rows = S.nvd_items(S.read_nvd(spark, d), "NVD", "cve", 1, NOW).orderBy("title").collect()
    assert rows[0].title == "CVE-2024-0001: " + "x" * 80 + "..." and rows[0].cvss_score == 7.5
    assert rows[1].title == "CVE-2024-0002" and rows[1].cvss_score is None and str(rows[1].published) == "2024-01-31 00:00:00"


def test_kev_json(spark):
    d = _dir()
    vulns = [
        {"cveID": "CVE-2023-1", "vendorProject": "V", "product": "P", "vulnerabilityName": "N", "shortDescription": "D",
         "dateAdded": "2024-01-25", "dueDate": "2024-02-15"},
        {"cveID": "CVE-2015-2", "vendorProject": "V", "product": "P", "vulnerabilityName": "N", "shortDescription": "D",
         "dateAdded": "2024-01-25", "dueDate": ""},
        {"cveID": "X-1", "vendorProject": "V", "product": "P", "vulnerabilityName": "N", "shortDescription": "D",
         "dateAdded": "2024-01-26", "dueDate": ""},
        {"cveID": "CVE-2023-3", "vendorProject": "V", "product": "P", "vulnerabilityName": "N", "shortDescription": "D",
         "dateAdded": "2024-01-01", "dueDate": ""},
    ]
    with open(os.path.join(d, "kev.json"), "w") as f:
        json.dump({"vulnerabilities": vulns}, f)
    rows = S.kev_items(S.read_kev(spark, d), "KEV", "advisories", 1, CUTOFF, NOW).orderBy("title").collect()
    assert [r.title for r in rows] == ["[CISA KEV] CVE-2023-1 — V P: N", "[CISA KEV] X-1 — V P: N"]
    assert rows[0].description == "Patch required by 2024-02-15. Actively exploited in the wild. Patch is available. D"
    assert rows[1].description == "Actively exploited in the wild. Patch is available. D" and rows[0].cvss_score == 9.0


def test_osv_folder_and_guard(spark):
    d = _dir()
    os.makedirs(os.path.join(d, "PyPI"))
    for i in range(10):
        rec = {"id": f"PYSEC-{i}", "summary": "s" if i % 2 else "", "details": "dd", "aliases": ["CVE-2024-9", "GHSA-1"],
               "modified": "2024-01-29T00:00:00Z" if i != 3 else "junk",
               "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/BS:8.1"}]}
        with open(os.path.join(d, "PyPI", f"PYSEC-{i}.json"), "w") as f:
            json.dump(rec, f)
    rows = S.osv_items(S.read_osv(spark, d), "OSV", "cve", 1, CUTOFF).collect()
    assert len(rows) == 8 and all(r.cvss_score == 8.1 and r.cve_ids == ["CVE-2024-9"] for r in rows)
    assert "PYSEC-3" not in {r.title.split(":")[0] for r in rows}
    man = spark.createDataFrame([
        ("PyPI", "a/ok.json", 10), ("PyPI", "../evil.json", 10), ("PyPI", "/abs.json", 10), ("PyPI", "x\\..\\y.json", 10),
        ("PyPI", "big.json", 11 * 1024 * 1024), ("PyPI", "readme.txt", 1),
        ("npm", "ok.json", 10), ("npm", "huge.bin", 151 * 1024 * 1024),
    ], "ecosystem STRING, filename STRING, file_size BIGINT")
    kept = sorted((r.ecosystem, r.filename) for r in S.archive_manifest_guard(man).collect())
    assert kept == [("PyPI", "a/ok.json")]


def test_hn_and_json_feed(spark):
    ids = spark.createDataFrame([(i, 100 + i) for i in range(250)], "rank BIGINT, id BIGINT")
    items = spark.createDataFrame(
        [(100 + i, "story" if i % 5 else "comment", f"New exploit {i}" if i % 2 else "Cooking", 1706500000, "" if i % 3 else f"https://x/{i}", i, 2)
         for i in range(250)],
        "id BIGINT, type STRING, title STRING, time BIGINT, url STRING, score INT, descendants INT",
    )
    rows = S.hn_items(ids, items, "HN", "community", 2, CUTOFF).collect()
    assert len(rows) == 30 and all("exploit" in r.title for r in rows)
    assert rows[0].description.startswith("HackerNews | ")
    d = _dir()
    feed = {"meta": 1, "data": [{"name": f"T{i}", "html_url": f"https://f/{i}", "body": "<b>B</b>", "created_at": "2024-01-29T00:00:00Z"} for i in range(60)]}
    with open(os.path.join(d, "f.json"), "w") as f:
        json.dump(feed, f)
    got = S.json_feed_items(S.read_json_feed(spark, d), "Feed", "blogs", 2, CUTOFF, NOW).collect()
    assert len(got) == 50 and got[0].description == "B"


def test_registry(spark):
    reg = spark.createDataFrame([
        ("cve", "A", "nvd_api", "u", 1, True), ("advisories", "B", "json_api", "https://www.CISA.gov/x", None, None),
        ("blogs", "C", "rss", "u", 2, False), ("blogs", "D", "smtp", "u", 2, True),
    ], S.REGISTRY_SCHEMA)
    got = sorted((r.name, r.parser, r.tier) for r in S.active_registry(reg).collect())
    assert got == [("A", "nvd", 1), ("B", "kev", 3)]


def test_description_of_any_text_collapses_it_whole(spark):
    from feedlens.functions import text as T
    from feedlens.sources import tables as TB

    gaps = ["a" + " " * n + "b " * 600 for n in (1, 600, 624, 625, 626, 1999, 2001, 5000)]
    texts = [*gaps, "x" * 500, "x " * 250, "x　 " * 700, "w" * 10_000, " " * 3000, "short", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = TB.with_lead(rows, "text", "description").withColumn("whole", T.collapse_truncate("text"))
    assert got.columns == ["id", "text", "description", "whole"]
    assert got.where(~F.col("description").eqNullSafe(F.col("whole"))).count() == 0
    # the prefix is collapsed once, and longer ones stand in a branch of their own
    plan = TB.with_lead(rows, "text", "description")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 4
