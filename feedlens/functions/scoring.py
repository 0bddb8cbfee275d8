"""Relevance score 0–100 (S11, S19–S24) as one native expression."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import count_contained


def now_lit(now: dt.datetime | str) -> Column:
    if isinstance(now, str):
        return F.to_timestamp(F.lit(now))
    if now.tzinfo is not None:
        now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(now).cast("timestamp_ntz").cast("timestamp")


def age_hours(published: Column, now) -> Column:
    """Hours since publication, never negative (naive values are UTC)."""
    micros = F.unix_micros(now_lit(now)) - F.unix_micros(published)
    return F.greatest(micros / F.lit(3.6e9), F.lit(0.0))


def cvss_component(cvss: Column, weight: float) -> Column:
    """Missing CVSS scores 0 (``least`` would skip the NULL and give 10)."""
    return F.when(cvss.isNull(), F.lit(0.0)).otherwise(F.least(cvss, F.lit(10.0)) / F.lit(10.0) * F.lit(float(weight)))


def recency_component(age: Column, weight: float) -> Column:
    return F.lit(float(weight)) * F.pow(F.lit(0.5), age / F.lit(C.RECENCY_HALF_LIFE_HOURS))


def tier_component(tier: Column, weight: float) -> Column:
    share = F.lit(C.TIER_OTHER)
    expr = None
    for t, s in C.TIER_SHARE.items():
        expr = (F.when(tier == t, F.lit(s)) if expr is None else expr.when(tier == t, F.lit(s)))
    return expr.otherwise(share) * F.lit(float(weight))


def engagement_component(points: Column, weight: float) -> Column:
    full = math.log(C.ENGAGEMENT_FULL_POINTS + 1)
    return F.when(
        points <= 0, F.lit(0.0)
    ).otherwise(F.least(F.ln(points + 1) / F.lit(full), F.lit(1.0)) * F.lit(float(weight)))


def watchlist_component(title: Column, description: Column, watchlist: list[str], weight: float) -> Column:
    if not watchlist:
        return F.lit(0.0)
    combined = F.lower(F.concat_ws(" ", title, description))
    hits = count_contained(combined, watchlist)
    return F.least(hits / F.lit(float(C.WATCHLIST_FULL_HITS)), F.lit(1.0)) * F.lit(float(weight))


def relevance_score(
    now,
    watchlist: list[str] | None = None,
    weights: dict | None = None,
    title="title",
    description="description",
    cvss="cvss_score",
    tier="source_tier",
    points="hn_points",
    published="published",
) -> Column:
    """round(min(sum of components, 100), 1), summed in a fixed order."""
    w = dict(C.DEFAULT_WEIGHTS)
    w.update(weights or {})
    watchlist = C.DEFAULT_WATCHLIST if watchlist is None else watchlist
    col = lambda x: F.col(x) if isinstance(x, str) else x
    total = (
        cvss_component(col(cvss), w["cvss_weight"])
        + recency_component(age_hours(col(published), now), w["recency_weight"])
        + tier_component(col(tier), w["source_tier_weight"])
        + engagement_component(col(points), w["engagement_weight"])
        + watchlist_component(col(title), F.coalesce(col(description), F.lit("")), watchlist, w["watchlist_weight"])
    )
    return F.round(F.least(total, F.lit(100.0)), 1)
