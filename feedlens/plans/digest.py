"""P1 news digest: window → dedup → score → filters → keywords → topics → report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

from .. import constants as C
from ..functions import display as D
from ..functions import text as T
from ..functions.scoring import age_hours, relevance_score
from ..operators import filters as FL
from ..operators import report as R
from ..operators.dedup import PairFinder, deduplicate
from ..operators.similarity import similar_title_pairs
from ..operators.topics import cluster, with_keywords


@dataclass
class Digest:
    clusters: DataFrame      # one row per cluster, with cluster_rank
    rows: DataFrame          # SNK1: one row per shown item, ordered by (cluster_rank, item_rank)
    funnel: DataFrame        # A9: one row
    attribution: DataFrame   # long-form duplicate sources of every survivor


def scored_survivors(
    raw: DataFrame,
    now,
    hours: float,
    categories: list[str] | None,
    threshold: float,
    watchlist: list[str] | None,
    weights: dict | None,
    pairs_of: PairFinder = similar_title_pairs,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared front half of both reports: look-back + categories (the
    fetch step), exact+fuzzy dedup, scoring. Returns (window, scored, attribution)."""
    window = FL.categories(FL.lookback(raw, now, hours), categories)
    survivors, attribution = deduplicate(window, threshold, pairs_of)
    scored = survivors.withColumn("score", relevance_score(now, watchlist, weights))
    return window, scored, attribution


def news_digest(
    raw: DataFrame,
    now,
    hours: float = C.DEFAULT_DIGEST_HOURS,
    categories: list[str] | None = None,
    keyword: str | None = None,
    min_score: float = C.DEFAULT_MIN_SCORE,
    threshold: float = C.DEFAULT_SIMILARITY_THRESHOLD,
    watchlist: list[str] | None = None,
    weights: dict | None = None,
    verbose: bool = False,
) -> Digest:
    window, scored, attribution = scored_survivors(raw, now, hours, categories, threshold, watchlist, weights)
    shown = FL.min_score(FL.keyword_filter(scored, keyword), min_score)
    # arrival order decides; the fingerprint keeps items of several sources apart
    shown = cut_lineage(R.order_index(with_keywords(shown), [F.asc("pos"), F.asc("fp")], "item"))
    clusters, members = cluster(shown)

    # O3: top score desc, stable in discovery order (the lead's place), Other last on ties
    clusters = R.order_index(
        clusters, [F.desc("top_score"), F.asc("is_other"), F.asc("lead_key")], "cluster_rank"
    )
    cl = R.checked_broadcast(
        clusters.select("comp", "cluster_rank", F.col("name").alias("cluster_name"), "shared_keywords", F.col("size").alias("cluster_size"))
    )
    m = members.join(cl, "comp")
    if verbose:
        m = R.order_index(m, [F.asc("cluster_rank")] + R.score_order(), "_g")
        first = m.groupBy("comp").agg(F.min("_g").alias("_g0"))
        m = m.join(first, "comp").withColumn("item_rank", F.col("_g") - F.col("_g0") + 1).drop("_g", "_g0")
    else:
        m = R.top_per_group(m, "comp", R.score_order(), C.DIGEST_ITEMS_PER_CLUSTER, "item_rank")
    also = R.first_sources(attribution)
    m = m.join(also, "fp", "left")
    age = age_hours(F.col("published"), now)
    rows = m.select(
        "cluster_rank",
        "cluster_name",
        T.first_n("shared_keywords", C.SHARED_KEYWORDS_SHOWN).alias("shared_keywords"),
        "cluster_size",
        (F.lit(0) if verbose else F.greatest(F.col("cluster_size") - F.lit(C.DIGEST_ITEMS_PER_CLUSTER), F.lit(0))).cast("int").alias("n_more"),
        "item_rank",
        D.severity_badge(F.col("cvss_score"), F.col("score")).alias("severity"),
        "score",
        D.score_band(F.col("score")).alias("score_style"),
        "title",
        D.age_label(age).alias("age"),
        T.first_n("cve_ids", C.CVES_SHOWN).alias("cves"),
        F.coalesce(F.col("also"), F.array().cast("array<string>")).alias("also"),
        "n_dup",
        "source_name",
        "source_category",
        "url",
        T.truncate_ellipsis(F.coalesce(F.col("description"), F.lit("")), C.DIGEST_DESC_MAX).alias("snippet"),
        "seq",
        "fp",
    )
    return Digest(clusters, rows, R.funnel(window, members), attribution)
