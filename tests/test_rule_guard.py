"""The literal pre-check never changes a rule's outcome."""

import random

from pyspark.sql import functions as F

from feedlens import constants as C
from feedlens.functions.incident import _rx
from feedlens.functions.rule_guard import guard, literals

RULES = [p for p, _ in C.INCIDENT_TYPE_RULES + C.IMPACT_RULES + C.ROOT_CAUSE_RULES] + [C.FIX_SIGNAL_PATTERN, C.NO_FIX_SIGNAL_PATTERN]


def _texts():
    rng = random.Random(9)
    words = ["Ransomware", "data breach", "73 million records exposed", "phiſhing", "PHISHING", "zero-day", "0day",
             "patch is available", "no patch available", "Unpatched", "unpatched", "DDoS", "denial-of-service", "XSS",
             "SQLi", "credential stuffing", "end-of-life", "thırd party", "MFA bypass", "İntrusion", "$22 million ransom",
             "systems taken offline", "version 2.1 fixes", "has not been patched", "nothing", "coin miner", "Vendor"]
    out = []
    for _ in range(300):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))))
    return out


def test_guard_is_exact(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "text STRING")
    text = F.col("text")
    cols = []
    for i, p in enumerate(RULES):
        cols.append((text.rlike(_rx(p)) == (guard(text, p) & text.rlike(_rx(p)))).alias(f"r{i}"))
    bad = df.select(*cols).where(~F.array_min(F.array(*[F.col(f"r{i}") for i in range(len(RULES))]))).count()
    assert bad == 0


def test_literals_examples():
    assert literals("ransomware|ransom demand") == ["ransomware", "ransom demand"]
    assert literals(r"(\$[\d,\.]+)") is None
    assert "record" in literals(C.IMPACT_RULES[0][0])
