"""Incident rules (S25–S31) pinned on the quirks the rules really have."""

import pytest
from pyspark.sql import functions as F

from feedlens.functions import incident as I


def _extract(spark, text):
    df = spark.createDataFrame([(text, "")], "title STRING, description STRING")
    return df.select(I.extract_incident().alias("i")).collect()[0].i


@pytest.mark.parametrize(
    "text,fixed",
    [
        ("no patch available", False),
        ("unpatched", True),
        ("not yet patched", True),
        ("no workaround available", True),
        ("no workaround", False),
        ("Patch is available. still vulnerable", True),
        ("has not been patched", True),
        ("patch not yet available", False),
        ("patching unavailable", None),
        ("nothing here", None),
    ],
)
def test_fix_status(spark, text, fixed):
    assert _extract(spark, text).is_fixed is fixed


def test_type_quirks(spark):
    assert _extract(spark, "because of this").incident_type == "Phishing"
    assert _extract(spark, "within 30 days").incident_type == "Zero-Day Exploit"
    assert _extract(spark, "within 30 days").root_cause.startswith("Zero-day")


def test_impact(spark):
    assert _extract(spark, "73 million records exposed").impact == "73 million records exposed"
    assert _extract(spark, "5 million records exposed").impact == "Not reported"
    assert _extract(spark, "PII exposed").impact == "Pii exposed"


def test_victim(spark):
    assert _extract(spark, "CISCO routers").victim == "CISCO"
    assert _extract(spark, "Hackers breached Acme Corp, stealing data").victim == "Acme Corp"


def test_defaults(spark):
    i = _extract(spark, "nothing here")
    assert (i.incident_type, i.victim, i.impact, i.root_cause, i.is_fixed) == (
        "Security Incident", "Unknown", "Not reported", "Under investigation", None)


def test_labels(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f BOOLEAN")
    got = [tuple(r) for r in df.select(I.fixed_label(F.col("f")), I.fixed_display(F.col("f")), I.status_color(F.col("f"))).collect()]
    assert got[0] == ("Yes — patch/fix available", "YES — Patch Available", "blue")
    assert got[1] == ("No — actively exploited / no patch", "NO  — No Fix / Actively Exploited", "red")
    assert got[2] == ("Unknown", "Unknown", "yellow")
