"""Row filters (F1–F9). All are plain predicates, so Catalyst pushes what it
can (look-back window, category) into the Parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions.scoring import now_lit


def lookback(df: DataFrame, now, hours: float, col: str = "published") -> DataFrame:
    """keep rows published at or after ``now - hours``."""
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    if now.tzinfo is not None:
        now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
    cutoff = now - dt.timedelta(hours=hours)
    return df.where(F.col(col) >= now_lit(cutoff))


def safe_url_filter(df: DataFrame, col: str = "url") -> DataFrame:
    """keep rows whose url is http(s) with an authority."""
    return df.where(T.safe_url(col).isNotNull())


def required_fields(df: DataFrame, title: str = "title", url: str = "url") -> DataFrame:
    """non-empty title and a link."""
    return df.where((F.coalesce(F.length(title), F.lit(0)) > 0) & F.col(url).isNotNull())


def security_related(df: DataFrame, col: str = "title", terms: list[str] | None = None) -> DataFrame:
    """any security term is a case-insensitive substring of the title."""
    terms = C.HN_SECURITY_TERMS if terms is None else terms
    return df.where(T.contains_any(F.lower(F.col(col)), terms))


def cve_year(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(r"^CVE-\p{Nd}{4}-"), F.regexp_extract(c, r"^CVE-(\p{Nd}{4})-", 1).cast("int"))


def legacy_cve(df: DataFrame, col: str = "cve_id", min_year: int = C.KEV_MIN_CVE_YEAR) -> DataFrame:
    """drop CVE ids whose year is before ``min_year``; ids without a year stay."""
    y = cve_year(col)
    return df.where(y.isNull() | (y >= min_year))


def incident_related(df: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """any incident term in lower(title + ' ' + description)."""
    terms = C.INCIDENT_TERMS if terms is None else terms
    text = F.lower(F.concat_ws(" ", F.col("title"), F.coalesce(F.col("description"), F.lit(""))))
    return df.where(T.contains_any(text, terms))


def keyword_filter(df: DataFrame, keyword: str | None) -> DataFrame:
    """keyword in lower(title) or in lower(description), tested separately."""
    if not keyword:
        return df
    kw = keyword.lower()
    return df.where(
        F.lower(F.col("title")).contains(kw) | F.lower(F.coalesce(F.col("description"), F.lit(""))).contains(kw)
    )


def min_score(df: DataFrame, threshold: float = C.DEFAULT_MIN_SCORE) -> DataFrame:
    """F8."""
    return df.where(F.col("score") >= F.lit(float(threshold)))


def categories(df: DataFrame, cats: list[str] | None) -> DataFrame:
    """keep listed source categories (None = all)."""
    if not cats:
        return df
    return df.where(F.col("source_category").isin(list(cats)))
