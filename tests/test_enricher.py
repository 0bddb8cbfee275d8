"""Enrichment responses (S36–S40, J6, A10): parsing, conversion, valid and invalid
answers, as response rows joined to items."""

import json

from pyspark.sql import functions as F

from conftest import make_items
from feedlens.functions import enrichment as E
from feedlens.plans.incidents import enrich

FULL = {
    "incident_type": "Ransomware", "victim": "Harbour Lines", "impact": "Booking down", "root_cause": "Stolen badge",
    "is_fixed": False, "severity_rationale": "Ships wait.", "ai_score_boost": 15,
}


def _parse(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw STRING").withColumn("c", E.strip_code_fence(F.col("raw")))
    df = df.withColumn("v", F.try_parse_json("c"))
    r = df.select("c", F.col("v").isNotNull().alias("ok"), E.validate_response(F.col("v"), F.col("c")).alias("valid"),
                  E.response_to_incident(F.col("v")).alias("i")).collect()[0]
    return r


def test_parse_clean_json(spark):
    r = _parse(spark, json.dumps(FULL))
    assert r.ok and r.valid and r.i.incident_type == "Ransomware" and r.i.victim == "Harbour Lines" and r.i.is_fixed is False


def test_parse_strips_markdown_fences(spark):
    d = dict(FULL, incident_type="Data Breach", victim="Post & Sons", root_cause=None, is_fixed=None, ai_score_boost=18)
    r = _parse(spark, "```json\n" + json.dumps(d) + "\n```")
    assert r.valid and r.i.incident_type == "Data Breach" and r.i.victim == "Post & Sons"
    assert r.i.root_cause == "Under investigation" and r.i.is_fixed is None and r.i.ai_score_boost == 18.0


def test_parse_invalid_json(spark):
    r = _parse(spark, "no object here")
    assert not r.ok and not r.valid


def test_null_fields_fall_back(spark):
    d = {k: None for k in FULL}
    d["incident_type"] = "Other"
    d["ai_score_boost"] = 0
    i = _parse(spark, json.dumps(d)).i
    assert (i.victim, i.impact, i.root_cause, i.is_fixed, i.ai_score_boost) == ("Unknown", "Not reported", "Under investigation", None, 0.0)


def test_string_bool_and_clamp(spark):
    i = _parse(spark, json.dumps(dict(FULL, is_fixed="true", ai_score_boost=25))).i
    assert i.is_fixed is True and i.ai_score_boost == 20.0
    i = _parse(spark, json.dumps(dict(FULL, is_fixed="false", ai_score_boost=-3))).i
    assert i.is_fixed is False and i.ai_score_boost == 0.0
    i = _parse(spark, json.dumps(dict(FULL, is_fixed="maybe", ai_score_boost=True))).i
    assert i.is_fixed is None and i.ai_score_boost == 1.0


def test_validation_rejects(spark):
    assert not _parse(spark, json.dumps({k: v for k, v in FULL.items() if k != "victim"})).valid
    assert not _parse(spark, json.dumps(dict(FULL, incident_type="Unknown Type"))).valid
    assert not _parse(spark, json.dumps(dict(FULL, incident_type=None))).valid
    assert not _parse(spark, json.dumps(dict(FULL, ai_score_boost="5"))).valid
    assert _parse(spark, json.dumps(dict(FULL, incident_type="Cross-Site Scripting"))).valid


def test_enrich_join_boost_and_stats(spark):
    items = make_items(spark, [
        {"seq": 1, "title": "Ransomware gang halts a ferry line", "description": "Bookings by phone only."},
        {"seq": 2, "title": "Gate left open", "description": "Nothing known yet"},
        {"seq": 3, "title": "Another", "description": "x"},
    ]).withColumn("score", F.lit(90.0))
    resp = spark.createDataFrame([(1, json.dumps(dict(FULL, ai_score_boost=18))), (2, "Sorry, no answer today.")], "seq BIGINT, raw STRING")
    out, stats = enrich(items, resp)
    rows = {r.seq: r for r in out.collect()}
    assert rows[1].ai_enriched and rows[1].score == 100.0 and rows[1].incident.victim == "Harbour Lines"
    assert not rows[2].ai_enriched and rows[2].score == 90.0 and rows[2].incident.incident_type == "Security Incident"
    s = stats.collect()[0]
    assert (s.total, s.ai_success, s.heuristic_fallback, s.all_failed) == (3, 1, 2, False)


def test_all_failed(spark):
    items = make_items(spark, [{"seq": 1, "title": "x"}]).withColumn("score", F.lit(50.0))
    resp = spark.createDataFrame([(1, "nope")], "seq BIGINT, raw STRING")
    s = enrich(items, resp)[1].collect()[0]
    assert s.all_failed and not s.ai_mode
