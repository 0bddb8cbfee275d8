"""P2 incident report and P3 enriched incident report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

from .. import constants as C
from ..functions import display as D
from ..functions import enrichment as E
from ..functions import incident as I
from ..functions import text as T
from ..functions.scoring import age_hours
from ..operators import filters as FL
from ..operators import report as R
from ..operators.dedup import PairFinder
from ..operators.similarity import similar_title_pairs
from .digest import scored_survivors


@dataclass
class IncidentReport:
    rows: DataFrame          # SNK2: one row per incident, ordered by ``idx``
    funnel: DataFrame        # A9
    stats: DataFrame | None  # A10 (enriched report only)
    attribution: DataFrame


def incident_candidates(
    raw: DataFrame,
    now,
    days: int = C.DEFAULT_INCIDENT_DAYS,
    categories: list[str] | None = None,
    keyword: str | None = None,
    min_score: float = C.DEFAULT_MIN_SCORE,
    threshold: float = C.DEFAULT_SIMILARITY_THRESHOLD,
    watchlist: list[str] | None = None,
    weights: dict | None = None,
    pairs_of: PairFinder = similar_title_pairs,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Window → dedup → score → incident filter (F6) → keyword (F7) → min score (F8)."""
    cats = C.DEFAULT_INCIDENT_CATEGORIES if categories is None else categories
    window, scored, attribution = scored_survivors(raw, now, days * 24, cats, threshold, watchlist, weights, pairs_of)
    items = FL.min_score(FL.keyword_filter(FL.incident_related(scored), keyword), min_score)
    return window, items, attribution


def enrich(items: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J6 + S36–S40 + A10.

    Of an item's valid responses the first in text order counts; invalid ones never hide it.
    A valid response replaces the heuristic fields and adds its boost to
    the score (capped at 100, not re-rounded); anything else falls back to
    the heuristic struct. Returns (items with ``incident``/``ai_enriched``,
    one-row stats).
    """
    cleaned = cut_lineage(responses.select("seq", "raw", E.strip_code_fence(F.col("raw")).alias("_clean")))
    valid = cleaned.where(E.validate_response(F.try_parse_json(F.col("_clean")), F.col("_clean")))
    # cleaning, validation, conversion and the rules are stages of their own: together they outgrow one compiled method
    first = cut_lineage(valid.groupBy("seq").agg(F.min_by("_clean", "raw").alias("_clean")))
    parsed = cut_lineage(first.select("seq", E.response_to_incident(F.try_parse_json("_clean")).alias("_ai")))
    j = cut_lineage(items.join(parsed, "seq", "left"))
    answered = (
        j.where(F.col("_ai").isNotNull())
        .withColumn("incident", F.col("_ai"))
        .withColumn("ai_enriched", F.lit(True))
        .withColumn("score", F.least(F.col("score") + F.col("_ai.ai_score_boost"), F.lit(100.0)))
        .drop("_ai")
    )
    ruled = (
        j.where(F.col("_ai").isNull()).drop("_ai").withColumn("incident", I.extract_incident()).withColumn("ai_enriched", F.lit(False))
    )
    out = cut_lineage(answered.unionByName(ruled))
    return out, enrichment_stats(out)


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """A10: total, ai_success, heuristic_fallback, all_failed (+ effective AI mode)."""
    s = enriched.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ai_enriched")).alias("ai_success"),
    )
    return s.select(
        "total",
        "ai_success",
        (F.col("total") - F.col("ai_success")).alias("heuristic_fallback"),
        ((F.col("total") > 0) & (F.col("ai_success") == 0)).alias("all_failed"),
        (~((F.col("total") > 0) & (F.col("ai_success") == 0))).alias("ai_mode"),
    )


def report_rows(items: DataFrame, attribution: DataFrame, now, ai_mode: bool = False) -> DataFrame:
    """W4 + SNK2: ranked incident rows with their display fields."""
    ranked = R.order_index(items, R.score_order(), "idx")
    age = age_hours(F.col("published"), now)
    desc = F.coalesce(F.col("description"), F.lit(""))
    ai_flag = F.col("ai_enriched") if "ai_enriched" in items.columns else F.lit(None).cast("boolean")
    return ranked.select(
        "idx",
        F.col("incident.incident_type").alias("incident_type"),
        I.type_icon(F.col("incident.incident_type")).alias("icon"),
        "score",
        D.score_band(F.col("score"), incident=True).alias("score_style"),
        D.age_label(age).alias("age"),
        "title",
        F.col("incident.victim").alias("victim"),
        T.first_n("cve_ids", C.CVES_SHOWN).alias("cves"),
        F.col("incident.impact").alias("impact"),
        F.col("incident.root_cause").alias("root_cause"),
        F.col("incident.is_fixed").alias("is_fixed"),
        I.fixed_display(F.col("incident.is_fixed")).alias("fixed"),
        I.status_color(F.col("incident.is_fixed")).alias("border"),
        F.when(F.lit(ai_mode) & F.coalesce(ai_flag, F.lit(True)), F.col("incident.severity_rationale")).otherwise(F.lit("")).alias("rationale"),
        ai_flag.alias("ai_enriched"),
        "source_name",
        F.substring("url", 1, C.URL_SHOWN_MAX).alias("url"),
        F.when(F.length(desc) > C.INCIDENT_SNIPPET_MIN, T.truncate_ellipsis(desc, C.INCIDENT_SNIPPET_MAX, rstrip=True)).alias("snippet"),
        "seq",
        "fp",
    )


def incident_report(raw: DataFrame, now, **kw) -> IncidentReport:
    """Heuristic extraction for every surviving incident."""
    window, items, attribution = incident_candidates(raw, now, **kw)
    items = items.withColumn("incident", I.extract_incident())
    rows = report_rows(items, attribution, now)
    return IncidentReport(rows, R.funnel(window, items), None, attribution)


def incident_report_enriched(raw: DataFrame, responses: DataFrame, now, **kw) -> IncidentReport:
    """P2 with external responses joined in, re-ranked by the boosted score."""
    window, items, attribution = incident_candidates(raw, now, **kw)
    enriched, stats = enrich(items, responses)
    ai_mode = bool(stats.first()["ai_mode"])
    rows = report_rows(enriched, attribution, now, ai_mode=ai_mode)
    return IncidentReport(rows, R.funnel(window, enriched), stats, attribution)
