import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from feedlens.functions.scoring import relevance_score
from feedlens.operators.dedup import deduplicate
from feedlens.plans.catalog import _padded
from feedlens.plans.incidents import enrich
from feedlens.sources import feeds as S
from feedlens.sources.run import run_sources
from feedlens.streaming.ingest import land, latest_report, stream_report_refresh

from conftest import NOW, make_items

DAY = "2024-01-30"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def feed(titles):
    return json.dumps([{"title": t, "url": f"https://x.example/{i}", "published_at": f"{DAY}T0{i}:00:00Z"} for i, t in enumerate(titles)])


REGISTRY = [
    ("blogs", "A", "json_api", "https://a.example", 2, True), ("blogs", "Missing", "rss", "https://m.example", 2, True),
    ("cve", "K", "json_api", "https://www.cisa.gov/x", 1, None), ("news", "R", "rss", "https://r.example", None, True), ("blogs", "Off", "rss", "https://o.example", 1, False),
    ("blogs", "B", "json_api", "https://b.example", 1, True),
]


@pytest.fixture(scope="module")
def landing():
    base = tempfile.mkdtemp(prefix="run-")
    write(f"{base}/A/f.json", feed(["Breach at one bank", "Router flaw fixed"]))
    write(f"{base}/B/f.json", feed(["Entirely different story", "Botnet returns"]))
    kev = [{"cveID": "CVE-2024-1", "vendorProject": "v", "product": "p", "vulnerabilityName": "n", "shortDescription": "d", "dateAdded": DAY, "dueDate": ""}]
    write(f"{base}/K/k.json", json.dumps({"vulnerabilities": kev}))
    atom = '<feed><entry><title>Atom story</title><link rel="self" href="https://s.example/"/><link href="https://atom.example/1"/><updated>2024-01-30T05:00:00Z</updated></entry></feed>'
    rss = "<rss><channel><item><title>Rss story</title><link>https://rss.example/1</link><pubDate>Tuesday, 30 Jan 24 00:00:00 EST</pubDate></item></channel></rss>"
    write(f"{base}/R/a.xml", atom)
    write(f"{base}/R/r.xml", rss)
    return base


def test_run_reads_every_source_and_reports_the_missing_one(spark, landing):
    got = run_sources(spark, spark.createDataFrame(REGISTRY, S.REGISTRY_SCHEMA), landing, NOW, 48)
    rows = got.items.collect()
    assert got.failed == ["Missing"]
    assert sorted(r.source_name for r in rows) == ["A", "A", "B", "B", "K", "R", "R"]
    assert len({r.seq for r in rows}) == 7
    by = {r.title: r for r in rows}
    assert by["Atom story"].url == "https://atom.example/1"
    assert by["Rss story"].published == dt.datetime(2024, 1, 30, 5, 0)
    # registry order decides who came first, whatever the readers number
    assert [r.source_name for r in sorted(rows, key=lambda r: r.seq)] == ["A", "A", "B", "B", "K", "R", "R"]
    only = run_sources(spark, spark.createDataFrame(REGISTRY, S.REGISTRY_SCHEMA), landing, NOW, 48, ["cve"])
    assert [r.source_name for r in only.items.collect()] == ["K"]


def test_no_source_at_all(spark):
    with pytest.raises(ValueError):
        run_sources(spark, spark.createDataFrame(REGISTRY, S.REGISTRY_SCHEMA), tempfile.mkdtemp(prefix="run-"), NOW, 48)


def test_equal_numbers_from_two_sources_stay_two_items(spark):
    items = make_items(spark, [{"seq": 0, "title": "Breach at one bank"}, {"seq": 0, "title": "Quite another headline entirely", "url": "https://e.example/9"}])
    survivors, attribution = deduplicate(items)
    assert survivors.count() == 2 and attribution.count() == 0
    assert {r.n_dup for r in survivors.collect()} == {0}


def test_stories(spark):
    base = tempfile.mkdtemp(prefix="run-")
    write(f"{base}/ids/top.json", "[5, 3, 4]")
    t = int(dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc).timestamp())
    stories = [{"id": i, "type": "story", "title": f"Ransomware attack {i}", "time": t, "score": i} for i in (3, 4, 5)]
    write(f"{base}/items/a.json", "\n".join(json.dumps(x) for x in stories))
    rows = S.hn_items(*S.read_hn(spark, base), "HN", "community", 2, NOW - dt.timedelta(days=3)).collect()
    assert [r.seq for r in rows] == [5, 3, 4] and rows[0].url.endswith("5")


def test_archive_guard_on_the_read(spark):
    base = tempfile.mkdtemp(prefix="run-")
    for name in ("GHSA-1.json", "GHSA-2.json"):
        write(f"{base}/PyPI/{name}", json.dumps({"id": name, "modified": f"{DAY}T00:00:00Z"}))
    manifest = spark.createDataFrame([("PyPI", "GHSA-1.json", 10), ("PyPI", "../GHSA-2.json", 10)], "ecosystem string, filename string, file_size bigint")
    assert S.read_osv(spark, base).count() == 2
    assert [r.filename for r in S.read_osv(spark, base, manifest).collect()] == ["GHSA-1.json"]


@pytest.mark.parametrize(
    "text,iso,rss",
    [
        ("2024", None, None), ("10:00:00", None, None), ("2024-01-30", dt.datetime(2024, 1, 30), None), ("2024-01-30T10:00:00+02:00", dt.datetime(2024, 1, 30, 8), None),
        ("Mon, 29 Jan 2024 10:00:00 PDT", None, dt.datetime(2024, 1, 29, 17)), ("29 Jan 24 10:00 GMT", None, dt.datetime(2024, 1, 29, 10)),
        ("Monday, 29 Jan 99 10:00:00 +0100", None, dt.datetime(1999, 1, 29, 9)), ("garbage", None, None),
    ],
)
def test_dates(spark, text, iso, rss):
    r = spark.createDataFrame([(text,)], "s string").select(S.parse_iso(F.col("s")).cast("timestamp_ntz"), S.parse_rfc822(F.col("s")).cast("timestamp_ntz")).first()
    assert (r[0], r[1]) == (iso, rss)


def test_long_numbers_keep_all_digits(spark):
    df = spark.range(999_990, 1_000_110).select(_padded("id", 4).alias("x"))
    assert df.distinct().count() == 120 and spark.range(1).select(_padded("id", 4)).first()[0] == "0000"


def test_an_invalid_answer_does_not_hide_a_valid_one(spark):
    items = make_items(spark, [{"seq": 1, "title": "Ransomware hits a bank"}]).withColumn("score", relevance_score(NOW))
    valid = {"incident_type": "Phishing", "victim": "bank", "impact": None, "root_cause": None, "is_fixed": None, "severity_rationale": None, "ai_score_boost": 5}
    answers = spark.createDataFrame([(1, "An error text"), (1, json.dumps(valid))], "seq bigint, raw string")
    row = enrich(items, answers)[0].first()
    assert row.ai_enriched and row.incident.victim == "bank"


def test_a_replayed_batch_doubles_nothing(spark):
    base = tempfile.mkdtemp(prefix="run-")
    items = make_items(spark, [{"seq": i, "title": f"Ransomware attack number {w} at a hospital", "age": 5, "cvss": 9.0, "category": "incidents"} for i, w in enumerate(["one", "forty two"])])
    land(items, f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    for state in ("s1", "s2"):  # a fresh checkpoint replays batch 0
        stream_report_refresh(spark, f"{base}/landing", schema, f"{base}/store", f"{base}/report", f"{base}/{state}", NOW, 14)
    assert spark.read.parquet(f"{base}/store").count() == 2
    assert latest_report(spark, f"{base}/report").count() == spark.read.parquet(f"{base}/report").count()


def test_run_over_all_kinds_of_source(spark):
    base = tempfile.mkdtemp(prefix="run-")
    seconds = int(dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc).timestamp())
    write(f"{base}/Json/f.json", feed(["Breach at one bank"]))
    write(f"{base}/Kev/k.json", json.dumps({"vulnerabilities": [{"cveID": "CVE-2024-1", "vendorProject": "v", "product": "p", "vulnerabilityName": "n", "shortDescription": "d", "dateAdded": DAY, "dueDate": ""}]}))
    write(f"{base}/Rss/r.xml", "<rss><channel><item><title>Rss story</title><link>https://rss.example/1</link><pubDate>Tue, 30 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>")
    write(f"{base}/Rss/a.xml", '<feed><entry><title>Atom story</title><link href="https://atom.example/1"/><updated>2024-01-30T05:00:00Z</updated></entry></feed>')
    cve = {"id": "CVE-2024-7", "published": f"{DAY}T00:00:00.000", "descriptions": [{"lang": "en", "value": "Overflow"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8}}]}}
    write(f"{base}/Nvd/n.json", json.dumps({"vulnerabilities": [{"cve": cve}]}))
    for name in ("GHSA-1", "GHSA-2"):
        write(f"{base}/Osv/PyPI/{name}.json", json.dumps({"id": name, "summary": "Flaw", "modified": f"{DAY}T00:00:00Z"}))
    write(f"{base}/Hn/ids/top.json", "[5]")
    write(f"{base}/Hn/items/a.json", json.dumps({"id": 5, "type": "story", "title": "Ransomware attack", "time": seconds, "score": 3}))
    manifest = spark.createDataFrame([("PyPI", "GHSA-1.json", 10), ("PyPI", "../GHSA-2.json", 10)], "ecosystem string, filename string, file_size bigint")
    types = {"Hn": "hn_api", "Json": "json_api", "Kev": "json_api", "Nvd": "nvd_api", "Osv": "osv_api", "Rss": "rss"}
    registry = [("cve", n, t, "https://www.cisa.gov/x" if n == "Kev" else "https://x.example", 1, True) for n, t in types.items()]
    got = run_sources(spark, spark.createDataFrame(registry, S.REGISTRY_SCHEMA), base, NOW, 48, manifest=manifest)
    assert got.failed == []
    rows = sorted((r.source_name, r.title) for r in got.items.collect())
    assert rows == [
        ("Hn", "Ransomware attack"), ("Json", "Breach at one bank"), ("Kev", "[CISA KEV] CVE-2024-1 — v p: n"), ("Nvd", "CVE-2024-7: Overflow"),
        ("Osv", "GHSA-1: Flaw"), ("Rss", "Atom story"), ("Rss", "Rss story"),
    ]


def test_records_of_a_run_start_from_given_items(spark, monkeypatch):
    from conftest import make_items
    from feedlens.plans import catalog as K

    def derived(*_):
        raise AssertionError("the items are derived again")

    monkeypatch.setattr(K, "_items", derived)
    items = make_items(spark, [{"title": f"Story {i}", "source_name": f"src{i}", "points": i} for i in range(20)])
    for made in (K._kev_rows, K._nvd_records, K._osv_records, K._feed_docs, K._archive_members):
        assert made(spark, None, items).count() > 0
    ranked, stories = K._story_rows(spark, None, items)
    assert ranked.count() == stories.count() == 20
