"""Scoring (S19–S24): what raises and lowers a score, and exact values."""

import math

from pyspark.sql import functions as F

from conftest import NOW, make_items
from feedlens.functions.scoring import relevance_score

W = {"cvss_weight": 30, "recency_weight": 25, "source_tier_weight": 20, "engagement_weight": 10, "watchlist_weight": 15}


def _score(spark, rows, watchlist=()):
    df = make_items(spark, rows)
    return [r.s for r in df.select("seq", relevance_score(NOW, list(watchlist), W).alias("s")).orderBy("seq").collect()]


def _py_score(cvss, age, tier, points, hits):
    c = 0.0 if cvss is None else min(cvss, 10.0) / 10.0 * 30
    r = 25 * math.pow(0.5, age / 12.0)
    t = {1: 1.0, 2: 0.66, 3: 0.33}.get(tier, 0.1) * 20
    e = 0.0 if points <= 0 else min(math.log(points + 1) / math.log(501), 1.0) * 10
    w = min(hits / 3, 1.0) * 15
    return round(min(c + r + t + e + w, 100.0), 1)


def test_each_part_moves_the_score_its_way(spark):
    plain = {"title": "Vendor bulletin", "cvss": 5.5, "age": 9, "tier": 2, "points": 20}
    better = [{"cvss": 8.1}, {"age": 3}, {"tier": 1}, {"points": 300}, {"title": "Vendor bulletin on spyware"}]
    worse = [{"cvss": None}, {"age": 90}, {"tier": 3}, {"points": 0}]
    base, *rest = _score(spark, [plain, *({**plain, **b} for b in better + worse)], ["spyware"])
    assert all(s > base for s in rest[: len(better)]) and all(0 < s < base for s in rest[len(better) :])


def test_scores_end_at_100(spark):
    words = ["spyware", "wiper", "worm"]
    most = {"title": " ".join(words), "cvss": 10.0, "age": 0, "tier": 1, "points": 5000}
    assert _score(spark, [most], words) == [100.0]


def test_matches_formula(spark):
    cases = [(9.8, 1.3, 1, 0, 0), (None, 30.7, 2, 12, 1), (4.2, 5.1, 3, 600, 2), (12.0, 100.2, 7, 1, 4)]
    rows = [{"title": "ransomware rce apt" if h else "plain", "cvss": c, "age": a, "tier": t, "points": p} for c, a, t, p, h in cases]
    got = _score(spark, rows, ["ransomware", "rce", "apt", "apt"][: max(h for *_, h in cases)])
    wl = ["ransomware", "rce", "apt", "apt"]
    for (c, a, t, p, h), g in zip(cases, got):
        hits = sum(1 for k in wl if k in ("ransomware rce apt" if h else "plain"))
        assert g == _py_score(c, a, t, p, hits)
