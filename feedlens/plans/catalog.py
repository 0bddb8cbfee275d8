"""Query catalog: one Spark query per operator, each with its DuckDB oracle.

Every query reads the driver tables (or data Spark derives from them) in
full. Parameters are fixed here so both sides compute the same thing:
reports run "as of" 2024-01-31 (the event data ends on 2024-01-30), the
digest looks back 720 h, the incident report 14 days.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import display as D
from ..functions import incident as I
from ..functions import scoring as S
from ..functions import text as T
from ..operators import filters as FL
from ..operators import report as R
from ..operators.dictionary import dictionary_hits, rows_with_terms
from ..operators.dedup import exact_attribution, exact_dedup, deduplicate, fuzzy_groups
from ..operators.similarity import similar_title_pairs
from ..operators.topics import cluster, shared_keyword_classes, shared_keyword_pairs, topic_components, with_keywords
from ..session import checkpoint_dir, cut_lineage
from ..sources.store import of_active_categories, read_items, write_items
from ..sources.tables import CATEGORY_BY_MOD6, news_items
from . import oracle_sql as O
from .digest import news_digest
from .incidents import incident_report

NOW = O.NOW
DIGEST_HOURS = 720
INCIDENT_DAYS = 14
MIN_SCORE = C.DEFAULT_MIN_SCORE
THRESHOLD = C.DEFAULT_SIMILARITY_THRESHOLD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _items(spark: SparkSession, sf: str) -> DataFrame:
    checkpoint_dir(spark)
    return news_items(spark, sf)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes)


NI = O.items_cte()


def _scalar(name: str, spark_expr: Callable[[], F.Column], sql_expr: str, extra: str = "") -> None:
    """Register a per-item scalar query: (seq, <name>) over the item table."""

    def fn(spark, sf):
        return _items(spark, sf).select("seq", spark_expr().alias(name))

    QUERIES[name] = fn
    ORACLES[name] = _with(NI) + f"\nSELECT seq, {sql_expr} AS {name} FROM news_items {extra}"


# ---------------------------------------------------------------- scalar text functions

_scalar("normalize_title", lambda: T.normalize_title("title"), O.norm_title("title"))
_scalar("normalize_url", lambda: T.normalize_url("url"), O.norm_url("url"))
_scalar("fingerprint", lambda: T.fingerprint("title", "url"), O.fingerprint("title", "url"))
_scalar(
    "extract_cves",
    lambda: F.array_join(T.extract_cves(F.concat_ws(" ", "title", "description")), ","),
    f"array_to_string({O.cves_expr("concat_ws(' ', title, description)")}, ',')",
)
_scalar(
    "capitalized_nouns",
    lambda: F.array_join(F.array_sort(T.capitalized_nouns(F.concat_ws(" ", "title", "description"))), ","),
    "array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(concat_ws(' ', title, description), "
    f"'[^{O.WORD}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{3,}}')), lambda w: lower(w)), lambda w: NOT list_contains(["
    + ", ".join(O.q(s) for s in C.NOUN_STOPWORDS)
    + "], w)))), ',')",
)
_scalar(
    "extract_keywords",
    lambda: F.array_join(T.extract_keywords(T.keyword_text()), "|"),
    f"array_to_string({O.keywords_expr(O.keyword_text())}, '|')",
)
_scalar(
    "known_term_match",
    lambda: F.array_join(F.array_sort(T.known_term_hits(F.lower(F.concat_ws(" ", "title", "description")))), "|"),
    "array_to_string(list_sort(list_filter(["
    + ", ".join(O.q(t) for t in T.known_terms())
    + "], lambda t: contains(lower(concat_ws(' ', title, description)), t))), '|')",
)
_scalar(
    "watchlist_match",
    lambda: T.count_contained(F.lower(F.concat_ws(" ", "title", "description")), C.DEFAULT_WATCHLIST),
    O.contains_count("lower(concat_ws(' ', title, description))", C.DEFAULT_WATCHLIST),
)
_scalar("age_hours", lambda: F.round(S.age_hours(F.col("published"), NOW), 6), f"round({O.age_hours()}, 6)")
_scalar(
    "truncate_ellipsis",
    lambda: F.concat_ws(
        "#",
        T.truncate_ellipsis("title", C.NVD_TITLE_DESC_MAX),
        T.truncate_ellipsis("description", C.DIGEST_DESC_MAX),
        T.truncate_ellipsis("description", C.INCIDENT_SNIPPET_MAX, rstrip=True),
    ),
    "concat_ws('#', "
    + ", ".join(
        f"concat({head}, CASE WHEN length({col}) > {n} THEN '...' ELSE '' END)"
        for col, n, head in [
            ("title", C.NVD_TITLE_DESC_MAX, f"substr(title, 1, {C.NVD_TITLE_DESC_MAX})"),
            ("description", C.DIGEST_DESC_MAX, f"substr(description, 1, {C.DIGEST_DESC_MAX})"),
            ("description", C.INCIDENT_SNIPPET_MAX, f"regexp_replace(substr(description, 1, {C.INCIDENT_SNIPPET_MAX}), '\\s+$', '')"),
        ]
    )
    + ")",
)
_scalar(
    "first_n_list",
    lambda: F.concat_ws("#", F.array_join(T.first_n("cve_ids", C.CVES_SHOWN), ","), F.substring("url", 1, C.URL_SHOWN_MAX)),
    f"concat_ws('#', array_to_string(cve_ids[1:{C.CVES_SHOWN}], ','), substr(url, 1, {C.URL_SHOWN_MAX}))",
)

# ---------------------------------------------------------------- score components

_W = C.DEFAULT_WEIGHTS
_scalar(
    "cvss_component",
    lambda: F.round(S.cvss_component(F.col("cvss_score"), _W["cvss_weight"]), 9),
    f"round(CASE WHEN cvss_score IS NULL THEN 0.0::DOUBLE ELSE least(cvss_score, 10.0::DOUBLE) / 10.0::DOUBLE * {_W['cvss_weight']}::DOUBLE END, 9)",
)
_scalar(
    "recency_component",
    lambda: F.round(S.recency_component(S.age_hours(F.col("published"), NOW), _W["recency_weight"]), 9),
    f"round({_W['recency_weight']}::DOUBLE * pow(0.5::DOUBLE, {O.age_hours()} / 12.0::DOUBLE), 9)",
)
_scalar(
    "tier_component",
    lambda: F.round(S.tier_component(F.col("source_tier"), _W["source_tier_weight"]), 9),
    "round((CASE source_tier "
    + " ".join(f"WHEN {t} THEN {s}::DOUBLE" for t, s in C.TIER_SHARE.items())
    + f" ELSE {C.TIER_OTHER}::DOUBLE END) * {_W['source_tier_weight']}::DOUBLE, 9)",
)
_scalar(
    "engagement_component",
    lambda: F.round(S.engagement_component(F.col("hn_points"), _W["engagement_weight"]), 9),
    f"round(CASE WHEN hn_points <= 0 THEN 0.0::DOUBLE ELSE least(ln(hn_points + 1) / ln(501), 1.0::DOUBLE) * {_W['engagement_weight']}::DOUBLE END, 9)",
)
_scalar(
    "watchlist_component",
    lambda: F.round(S.watchlist_component(F.col("title"), F.col("description"), C.DEFAULT_WATCHLIST, _W["watchlist_weight"]), 9),
    f"round(least({O.contains_count("lower(concat_ws(' ', title, coalesce(description, '')))", C.DEFAULT_WATCHLIST)} / 3.0::DOUBLE, 1.0::DOUBLE) * {_W['watchlist_weight']}::DOUBLE, 9)",
)
_scalar("relevance_score", lambda: S.relevance_score(NOW), O.score_expr())

# ---------------------------------------------------------------- incident fields

_ITEXT = "concat_ws(' ', title, coalesce(description, ''))"


def _incident_scalar(name: str, spark_fn, sql_expr: str) -> None:
    def fn(spark, sf):
        return _items(spark, sf).select("seq", spark_fn(I.incident_text()).alias(name))

    QUERIES[name] = fn
    ORACLES[name] = _with(NI, f"t AS (SELECT seq, {_ITEXT} AS text FROM news_items)") + f"\nSELECT seq, {sql_expr} AS {name} FROM t"


_incident_scalar("incident_type", I.incident_type, O.incident_type_sql())
_incident_scalar("victim", I.victim, O.victim_sql())
_incident_scalar("impact", I.impact, O.impact_sql())
_incident_scalar("root_cause", I.root_cause, O.root_cause_sql())
_incident_scalar("fix_status", I.fix_status, O.fix_status_sql())


@register(
    "extract_incident",
    _with(NI, f"t AS (SELECT seq, {_ITEXT} AS text FROM news_items)")
    + f"\nSELECT seq, {O.incident_struct_cols()} FROM t",
)
def q_extract_incident(spark, sf):
    return _items(spark, sf).select("seq", I.extract_incident().alias("i")).select(
        "seq", "i.incident_type", "i.victim", "i.impact", "i.root_cause", "i.is_fixed"
    )


def _tri_sql(col: str, labels: dict) -> str:
    return f"CASE WHEN {col} = true THEN {O.q(labels[True])} WHEN {col} = false THEN {O.q(labels[False])} ELSE {O.q(labels[None])} END"


@register(
    "fixed_label",
    _with(NI, f"t AS (SELECT seq, {_ITEXT} AS text FROM news_items)", f"f AS (SELECT seq, {O.fix_status_sql()} AS is_fixed FROM t)")
    + f"\nSELECT seq, {_tri_sql('is_fixed', C.FIXED_LABEL)} AS fixed_label, {_tri_sql('is_fixed', C.FIXED_DISPLAY)} AS fixed_display FROM f",
)
def q_fixed_label(spark, sf):
    f = _items(spark, sf).select("seq", I.fix_status(I.incident_text()).alias("is_fixed"))
    return f.select("seq", I.fixed_label(F.col("is_fixed")).alias("fixed_label"), I.fixed_display(F.col("is_fixed")).alias("fixed_display"))


@register(
    "status_color",
    _with(NI, f"t AS (SELECT seq, {_ITEXT} AS text FROM news_items)", f"f AS (SELECT seq, {O.fix_status_sql()} AS is_fixed, {O.incident_type_sql()} AS itype FROM t)")
    + f"\nSELECT seq, {_tri_sql('is_fixed', C.STATUS_COLOR)} AS border, CASE itype "
    + " ".join(f"WHEN {O.q(n)} THEN {O.q(i)}" for n, i in C.TYPE_ICONS)
    + f" ELSE {O.q(C.TYPE_ICON_DEFAULT)} END AS icon FROM f",
)
def q_status_color(spark, sf):
    text = I.incident_text()
    f = _items(spark, sf).select("seq", I.fix_status(text).alias("is_fixed"), I.incident_type(text).alias("itype"))
    return f.select("seq", I.status_color(F.col("is_fixed")).alias("border"), I.type_icon(F.col("itype")).alias("icon"))


def _band_sql(col: str, else_label: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {t} THEN {O.q(l)}" for t, l in C.SCORE_BANDS) + f" ELSE {O.q(else_label)} END"


_SEV_SQL = (
    "CASE WHEN cvss_score IS NOT NULL THEN (CASE "
    + " ".join(f"WHEN cvss_score >= {t} THEN {O.q(l)}" for t, l in C.SEVERITY_CVSS)
    + f" ELSE {O.q(C.SEVERITY_CVSS_ELSE)} END) ELSE (CASE "
    + " ".join(f"WHEN score >= {t} THEN {O.q(l)}" for t, l in C.SEVERITY_SCORE)
    + f" ELSE {O.q(C.SEVERITY_SCORE_ELSE)} END) END"
)


@register(
    "severity_badge",
    _with(NI, O.scored_cte()) + f"\nSELECT seq, {_SEV_SQL} AS severity FROM scored",
)
def q_severity_badge(spark, sf):
    s = _items(spark, sf).withColumn("score", S.relevance_score(NOW))
    return s.select("seq", D.severity_badge(F.col("cvss_score"), F.col("score")).alias("severity"))


@register(
    "score_band",
    _with(NI, O.scored_cte())
    + f"\nSELECT seq, {_band_sql('score', C.SCORE_BAND_ELSE_DIGEST)} AS digest_style, {_band_sql('score', C.SCORE_BAND_ELSE_INCIDENT)} AS incident_style FROM scored",
)
def q_score_band(spark, sf):
    s = _items(spark, sf).withColumn("score", S.relevance_score(NOW))
    return s.select("seq", D.score_band(F.col("score")).alias("digest_style"), D.score_band(F.col("score"), incident=True).alias("incident_style"))


_AGE_LABEL_SQL = (
    f"CASE WHEN a < 1 THEN concat(floor(a * 60)::BIGINT, 'm ago') WHEN a < 24 THEN concat(round_even(a, 0)::BIGINT, 'h ago') "
    "ELSE concat(round_even(a / 24, 0)::BIGINT, 'd ago') END"
)


@register(
    "age_label",
    _with(NI, f"a AS (SELECT seq, {O.age_hours()} AS a FROM news_items)") + f"\nSELECT seq, {_AGE_LABEL_SQL} AS age FROM a",
)
def q_age_label(spark, sf):
    return _items(spark, sf).select("seq", D.age_label(S.age_hours(F.col("published"), NOW)).alias("age"))


# ---------------------------------------------------------------- filters

@register(
    "lookback_filter",
    _with(NI) + f"\nSELECT seq, published FROM news_items WHERE published >= {O.NOW_SQL} - INTERVAL {INCIDENT_DAYS * 24} HOUR",
)
def q_lookback(spark, sf):
    return FL.lookback(_items(spark, sf), NOW, INCIDENT_DAYS * 24).select("seq", "published")


@register(
    "security_related_filter",
    _with(NI) + f"\nSELECT seq FROM news_items WHERE {O.contains_any('lower(title)', C.HN_SECURITY_TERMS)}",
)
def q_security_related(spark, sf):
    return FL.security_related(_items(spark, sf)).select("seq")


@register(
    "incident_related_filter",
    _with(NI) + f"\nSELECT seq FROM news_items WHERE {O.contains_any("lower(concat_ws(' ', title, coalesce(description, '')))", C.INCIDENT_TERMS)}",
)
def q_incident_related(spark, sf):
    return FL.incident_related(_items(spark, sf)).select("seq")


@register(
    "keyword_filter",
    _with(NI) + "\nSELECT seq FROM news_items WHERE contains(lower(title), 'ivanti') OR contains(lower(coalesce(description, '')), 'ivanti')",
)
def q_keyword(spark, sf):
    return FL.keyword_filter(_items(spark, sf), "Ivanti").select("seq")


@register(
    "min_score_filter",
    _with(NI, O.scored_cte()) + f"\nSELECT seq, score FROM scored WHERE score >= {MIN_SCORE}",
)
def q_min_score(spark, sf):
    return FL.min_score(_items(spark, sf).withColumn("score", S.relevance_score(NOW)), MIN_SCORE).select("seq", "score")


@register(
    "category_filter",
    _with(NI)
    + "\nSELECT seq, source_category FROM news_items WHERE source_category IN ("
    + ", ".join(O.q(c) for c in C.DEFAULT_INCIDENT_CATEGORIES)
    + ")",
)
def q_category(spark, sf):
    return FL.categories(_items(spark, sf), C.DEFAULT_INCIDENT_CATEGORIES).select("seq", "source_category")


# ---------------------------------------------------------------- dedup

_CANON = _with(NI, O.exact_cte("news_items"))


@register(
    "exact_dedup",
    _CANON + "\nSELECT fp, seq, pos, n_copies, source_tier, source_name FROM canon",
)
def q_exact_dedup(spark, sf):
    return exact_dedup(_items(spark, sf)).select("fp", "seq", "pos", "n_copies", "source_tier", "source_name")


@register(
    "dedup_attribution",
    _with(NI, O.exact_cte("news_items"), O.exact_attr_cte("canon_fp")) + "\nSELECT fp, seq, ord, source_name FROM exact_attr WHERE ord IS NOT NULL",
)
def q_dedup_attribution(spark, sf):
    return exact_attribution(_items(spark, sf)).select("fp", "seq", "ord", "source_name")


@register(
    "dedup_order",
    _CANON
    + "\nSELECT fp, row_number() OVER (ORDER BY source_tier, published DESC, pos) AS scan_idx FROM canon",
)
def q_dedup_order(spark, sf):
    from ..operators.dedup import scan_rank_cols

    c = scan_rank_cols(exact_dedup(_items(spark, sf)))
    return R.order_index(c, [F.asc("r_tier"), F.asc("r_neg_pub"), F.asc("r_pos")], "scan_idx").select("fp", "scan_idx")


@register(
    "fuzzy_title_pairs",
    _with(NI, O.exact_cte("news_items"), O.fuzzy_ctes("canon", THRESHOLD))
    + "\nSELECT least(x.nt, y.nt) AS title_a, greatest(x.nt, y.nt) AS title_b FROM fz_pairs p JOIN fz_titles x ON x.tid = p.a JOIN fz_titles y ON y.tid = p.b",
)
def q_fuzzy_pairs(spark, sf):
    c = exact_dedup(_items(spark, sf)).withColumn("nt", T.normalize_title("title"))
    titles = cut_lineage(c.groupBy("nt").agg(F.min("pos").alias("tid")))
    pairs = similar_title_pairs(titles, THRESHOLD)
    ta = titles.select(F.col("tid").alias("a"), F.col("nt").alias("x"))
    tb = titles.select(F.col("tid").alias("b"), F.col("nt").alias("y"))
    return pairs.join(ta, "a").join(tb, "b").select(F.least("x", "y").alias("title_a"), F.greatest("x", "y").alias("title_b"))


@register(
    "fuzzy_dedup",
    _with(NI, O.exact_cte("news_items"), O.fuzzy_ctes("canon", THRESHOLD)) + "\nSELECT fp, leader_fp, is_leader FROM fz_groups",
)
def q_fuzzy_dedup(spark, sf):
    canon = cut_lineage(exact_dedup(_items(spark, sf)))
    return fuzzy_groups(canon, THRESHOLD).select("fp", "leader_fp", "is_leader")


@register(
    "fuzzy_attribution",
    _with(NI, O.exact_cte("news_items"), O.exact_attr_cte("canon_fp"), O.fuzzy_ctes("canon", THRESHOLD))
    + """
    SELECT g.fp, 0 AS stage, a.ord AS o1, 0::BIGINT AS o2, 0::BIGINT AS o3, a.source_name
    FROM fz_groups g JOIN exact_attr a ON a.fp = g.fp WHERE g.is_leader AND a.ord IS NOT NULL
    UNION ALL
    SELECT leader_fp AS fp, 1 AS stage, r_tier::BIGINT AS o1, r_neg_pub AS o2, r_pos AS o3, source_name
    FROM fz_groups WHERE NOT is_leader""",
)
def q_fuzzy_attribution(spark, sf):
    _, attribution = deduplicate(_items(spark, sf), THRESHOLD)
    return attribution.select("fp", "stage", F.col("ord.o1").alias("o1"), F.col("ord.o2").alias("o2"), F.col("ord.o3").alias("o3"), "source_name")


# ---------------------------------------------------------------- counts / sets

@register("source_item_counts", _with(NI) + "\nSELECT source_name, count(*) AS n_items FROM news_items GROUP BY source_name")
def q_source_counts(spark, sf):
    return R.source_item_counts(_items(spark, sf))


@register("distinct_sources", _with(NI) + "\nSELECT DISTINCT source_name FROM news_items")
def q_distinct_sources(spark, sf):
    return R.distinct_sources(_items(spark, sf))


@register(
    "distinct_cves",
    _with(NI) + "\nSELECT seq, array_to_string(cve_ids, ',') AS cves, len(cve_ids) AS n_cves FROM news_items",
)
def q_distinct_cves(spark, sf):
    return _items(spark, sf).select("seq", F.array_join("cve_ids", ",").alias("cves"), F.size("cve_ids").alias("n_cves"))


@register(
    "score_sort",
    _with(NI, O.exact_cte("news_items"), "s AS (SELECT *, " + O.score_expr() + " AS score FROM canon)")
    + "\nSELECT fp, score, row_number() OVER (ORDER BY score DESC, source_tier, published DESC, pos) AS idx FROM s",
)
def q_score_sort(spark, sf):
    from ..operators.dedup import scan_rank_cols

    s = scan_rank_cols(exact_dedup(_items(spark, sf))).withColumn("score", S.relevance_score(NOW))
    return R.order_index(s, R.score_order(), "idx").select("fp", "score", "idx")


# ---------------------------------------------------------------- topics (over exact-dedup survivors)

_TOPIC = _with(NI, O.exact_cte("news_items"), O.topic_input_cte(), O.topic_ctes("topic_src"))


def _topic_items(spark, sf):
    from ..operators.dedup import scan_rank_cols

    s = scan_rank_cols(exact_dedup(_items(spark, sf))).withColumn("score", S.relevance_score(NOW))
    s = FL.min_score(s, MIN_SCORE).withColumn("item", F.col("pos"))
    return cut_lineage(with_keywords(s))


@register("shared_keyword_pairs", _TOPIC + "\nSELECT a, b, n_shared FROM tp_pairs")
def q_shared_pairs(spark, sf):
    return shared_keyword_pairs(_topic_items(spark, sf))


@register(
    "shared_keyword_classes",
    _TOPIC.rstrip().rstrip(",")
    + """,
    kc AS (SELECT keywords AS ks, min(item) AS cls, count(*) AS n FROM (SELECT item, list_sort(list_distinct(list(kw))) AS keywords FROM tp_kw GROUP BY item) GROUP BY keywords)
    SELECT a.cls AS cls_a, b.cls AS cls_b, len(list_intersect(a.ks, b.ks))::INT AS n_shared,
           CASE WHEN a.cls = b.cls THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_links
    FROM kc a JOIN kc b ON a.cls <= b.cls
    WHERE len(list_intersect(a.ks, b.ks)) >= 2 AND (a.cls < b.cls OR a.n > 1)""",
)
def q_shared_classes(spark, sf):
    return shared_keyword_classes(_topic_items(spark, sf))[0]


@register("topic_components", _TOPIC + "\nSELECT node AS item, comp FROM tp_reach")
def q_topic_components(spark, sf):
    return topic_components(_topic_items(spark, sf))


def _clusters(spark, sf):
    clusters, members = cluster(_topic_items(spark, sf))
    ranked = R.order_index(clusters, [F.desc("top_score"), F.asc("is_other"), F.asc("lead_key")], "cluster_rank")
    return ranked, members


@register("cluster_name", _TOPIC + "\nSELECT comp, name FROM tp_clusters")
def q_cluster_name(spark, sf):
    return _clusters(spark, sf)[0].select("comp", "name")


@register(
    "cluster_shared_keywords",
    _TOPIC + "\nSELECT comp, array_to_string(shared_keywords, '|') AS shared_keywords FROM tp_clusters",
)
def q_cluster_shared(spark, sf):
    return _clusters(spark, sf)[0].select("comp", F.array_join("shared_keywords", "|").alias("shared_keywords"))


@register(
    "cluster_summary",
    _TOPIC + "\nSELECT comp, size, top_score, lead_item, is_other FROM tp_clusters",
)
def q_cluster_summary(spark, sf):
    return _clusters(spark, sf)[0].select("comp", "size", "top_score", "lead_item", "is_other")


@register("cluster_sort", _TOPIC + "\nSELECT comp, cluster_rank, top_score FROM tp_clusters")
def q_cluster_sort(spark, sf):
    return _clusters(spark, sf)[0].select("comp", "cluster_rank", "top_score")


@register(
    "top5_per_cluster",
    _TOPIC
    + f"""
    SELECT c.cluster_rank, m.item,
           row_number() OVER (PARTITION BY m.comp ORDER BY m.score DESC, m.r_tier, m.r_neg_pub, m.r_pos) AS item_rank,
           greatest(c.size - {C.DIGEST_ITEMS_PER_CLUSTER}, 0) AS n_more
    FROM tp_members m JOIN tp_clusters c ON c.comp = m.comp
    QUALIFY item_rank <= {C.DIGEST_ITEMS_PER_CLUSTER}""",
)
def q_top5(spark, sf):
    clusters, members = _clusters(spark, sf)
    m = members.join(clusters.select("comp", "cluster_rank", "size"), "comp")
    top = R.top_per_group(m, "comp", R.score_order(), C.DIGEST_ITEMS_PER_CLUSTER, "item_rank")
    return top.select(
        "cluster_rank", "item", "item_rank", F.greatest(F.col("size") - C.DIGEST_ITEMS_PER_CLUSTER, F.lit(0)).alias("n_more")
    )


@register(
    "keyword_union",
    _with(NI)
    + f"""
    SELECT seq, array_to_string({O.keywords_expr(O.keyword_text())}, '|') AS keywords,
           len({O.keywords_expr(O.keyword_text())}) AS n_keywords FROM news_items""",
)
def q_keyword_union(spark, sf):
    k = with_keywords(_items(spark, sf))
    return k.select("seq", F.array_join("keywords", "|").alias("keywords"), F.size("keywords").alias("n_keywords"))


# ---------------------------------------------------------------- composite: news digest

def _digest(spark, sf):
    return news_digest(_items(spark, sf), NOW, hours=DIGEST_HOURS, min_score=MIN_SCORE, threshold=THRESHOLD)


_DIGEST_SQL = _with(
    NI,
    O.window_cte(DIGEST_HOURS, None),
    O.survivors_ctes(THRESHOLD),
    f"shown AS (SELECT *, pos AS item FROM surv WHERE score >= {MIN_SCORE})",
    O.topic_ctes("shown"),
    """dm AS (SELECT m.*, c.cluster_rank, c.name AS cluster_name, c.shared_keywords AS c_shared, c.size AS cluster_size
              FROM tp_members m JOIN tp_clusters c ON c.comp = m.comp)""",
) + f"""
    SELECT cluster_rank, cluster_name, array_to_string(c_shared[1:{C.SHARED_KEYWORDS_SHOWN}], '|') AS shared_keywords,
           cluster_size, greatest(cluster_size - {C.DIGEST_ITEMS_PER_CLUSTER}, 0) AS n_more,
           row_number() OVER (PARTITION BY comp ORDER BY score DESC, r_tier, r_neg_pub, r_pos) AS item_rank,
           {O.severity_sql()} AS severity,
           score, {O.band_sql('score', C.SCORE_BAND_ELSE_DIGEST)} AS score_style, title,
           {O.age_label_sql(O.age_hours('published'))} AS age,
           array_to_string(cve_ids[1:{C.CVES_SHOWN}], ',') AS cves,
           array_to_string(names[1:{C.DUP_SOURCES_SHOWN}], ',') AS also, n_dup, source_name, source_category, url,
           concat(substr(coalesce(description, ''), 1, {C.DIGEST_DESC_MAX}),
                  CASE WHEN length(coalesce(description, '')) > {C.DIGEST_DESC_MAX} THEN '...' ELSE '' END) AS snippet,
           seq, fp
    FROM dm
    QUALIFY item_rank <= {C.DIGEST_ITEMS_PER_CLUSTER}"""


def _digest_rows(d) -> DataFrame:
    return d.rows.select(
        "cluster_rank", "cluster_name", F.array_join("shared_keywords", "|").alias("shared_keywords"), "cluster_size", "n_more",
        "item_rank", "severity", "score", "score_style", "title", "age", F.array_join("cves", ",").alias("cves"),
        F.array_join("also", ",").alias("also"), "n_dup", "source_name", "source_category", "url", "snippet", "seq", "fp",
    )


@register("news_digest", _DIGEST_SQL)
def q_news_digest(spark, sf):
    return _digest_rows(_digest(spark, sf))


@register(
    "digest_funnel",
    _with(
        NI,
        O.window_cte(DIGEST_HOURS, None),
        O.survivors_ctes(THRESHOLD),
    )
    + f"""
    SELECT (SELECT count(*) FROM win) AS total_raw,
           (SELECT count(*) FROM surv WHERE score >= {MIN_SCORE}) AS items_shown,
           (SELECT count(*) FROM win) - (SELECT count(*) FROM surv WHERE score >= {MIN_SCORE}) AS removed,
           (SELECT count(DISTINCT source_name) FROM win) AS sources_hit""",
)
def q_digest_funnel(spark, sf):
    return _digest(spark, sf).funnel


# ---------------------------------------------------------------- composite: incident report

def _incident_sql_rows(src: str, extra_cols: str = "", rationale: str = "''", ai: str = "NULL::BOOLEAN") -> str:
    return f"""
    SELECT row_number() OVER (ORDER BY score DESC, r_tier, r_neg_pub, r_pos) AS idx,
           incident_type,
           CASE incident_type {' '.join(f'WHEN {O.q(n)} THEN {O.q(i)}' for n, i in C.TYPE_ICONS)} ELSE {O.q(C.TYPE_ICON_DEFAULT)} END AS icon,
           score, {O.band_sql('score', C.SCORE_BAND_ELSE_INCIDENT)} AS score_style,
           {O.age_label_sql(O.age_hours('published'))} AS age, title, victim,
           array_to_string(cve_ids[1:{C.CVES_SHOWN}], ',') AS cves, impact, root_cause, is_fixed,
           {_tri_sql('is_fixed', C.FIXED_DISPLAY)} AS fixed, {_tri_sql('is_fixed', C.STATUS_COLOR)} AS border,
           {rationale} AS rationale, {ai} AS ai_enriched, source_name, substr(url, 1, {C.URL_SHOWN_MAX}) AS url,
           CASE WHEN length(coalesce(description, '')) > {C.INCIDENT_SNIPPET_MIN}
                THEN concat(regexp_replace(substr(description, 1, {C.INCIDENT_SNIPPET_MAX}), '\\s+$', ''),
                            CASE WHEN length(description) > {C.INCIDENT_SNIPPET_MAX} THEN '...' ELSE '' END) END AS snippet,
           seq, fp {extra_cols}
    FROM {src}"""


_INCIDENT_BASE = [
    NI,
    O.window_cte(INCIDENT_DAYS * 24, C.DEFAULT_INCIDENT_CATEGORIES),
    O.survivors_ctes(THRESHOLD),
    f"""inc AS (
      SELECT *, concat_ws(' ', title, coalesce(description, '')) AS text FROM surv
      WHERE {O.contains_any("lower(concat_ws(' ', title, coalesce(description, '')))", C.INCIDENT_TERMS)}
        AND score >= {MIN_SCORE})""",
]
_INCIDENT_SQL = _with(*_INCIDENT_BASE, f"inc2 AS (SELECT *, {O.incident_struct_cols()} FROM inc)") + _incident_sql_rows("inc2")


def _incident_rows(rep) -> DataFrame:
    return rep.rows.withColumn("cves", F.array_join("cves", ","))


@register("incident_report", _INCIDENT_SQL)
def q_incident_report(spark, sf):
    return _incident_rows(incident_report(_items(spark, sf), NOW, days=INCIDENT_DAYS, min_score=MIN_SCORE, threshold=THRESHOLD))


@register("incident_rank", _with(*_INCIDENT_BASE) + "\nSELECT seq, row_number() OVER (ORDER BY score DESC, r_tier, r_neg_pub, r_pos) AS idx FROM inc")
def q_incident_rank(spark, sf):
    from .incidents import incident_candidates

    _, items, _ = incident_candidates(_items(spark, sf), NOW, days=INCIDENT_DAYS, min_score=MIN_SCORE, threshold=THRESHOLD)
    return R.order_index(items, R.score_order(), "idx").select("seq", "idx")


# ---------------------------------------------------------------- enrichment

from ..functions import enrichment as E  # noqa: E402
from ..sources.responses import derived_responses, responses_sql  # noqa: E402
from .incidents import enrich, incident_candidates, incident_report_enriched  # noqa: E402

_RESP = f"responses_t AS ({responses_sql('news_items', False)})"


def _responses(spark, sf):
    return derived_responses(_items(spark, sf))


@register(
    "strip_code_fence",
    _with(NI, _RESP, O.enrichment_ctes()) + "\nSELECT seq, c AS cleaned FROM en_clean",
)
def q_strip_fence(spark, sf):
    r = _responses(spark, sf).groupBy("seq").agg(F.min("raw").alias("raw"))
    return r.select("seq", E.strip_code_fence(F.col("raw")).alias("cleaned"))


@register(
    "parse_response",
    _with(NI, _RESP, O.enrichment_ctes()) + "\nSELECT seq, j IS NOT NULL AS parsed FROM en_parsed",
)
def q_parse_response(spark, sf):
    r = _responses(spark, sf).groupBy("seq").agg(F.min("raw").alias("raw"))
    return r.select("seq", E.parse_response(F.col("raw")).isNotNull().alias("parsed"))


@register(
    "validate_response",
    _with(NI, _RESP, O.enrichment_ctes())
    + "\nSELECT p.seq, v.seq IS NOT NULL AS valid FROM en_parsed p LEFT JOIN en_valid v ON v.seq = p.seq",
)
def q_validate_response(spark, sf):
    r = _responses(spark, sf).groupBy("seq").agg(F.min("raw").alias("raw")).withColumn("c", E.strip_code_fence(F.col("raw")))
    return r.select("seq", E.validate_response(F.try_parse_json("c"), F.col("c")).alias("valid"))


@register(
    "response_to_incident",
    _with(NI, _RESP, O.enrichment_ctes())
    + "\nSELECT seq, incident_type, victim, impact, root_cause, is_fixed, severity_rationale, ai_score_boost FROM en_fields",
)
def q_response_to_incident(spark, sf):
    r = _responses(spark, sf).groupBy("seq").agg(F.min("raw").alias("raw")).withColumn("c", E.strip_code_fence(F.col("raw")))
    r = r.withColumn("v", F.try_parse_json("c")).where(E.validate_response(F.col("v"), F.col("c")))
    return r.select("seq", E.response_to_incident(F.col("v")).alias("i")).select("seq", "i.*")


_ENRICHED_BASE = _INCIDENT_BASE + [
    _RESP,
    O.enrichment_ctes(),
    f"""inc_h AS (SELECT *, {O.incident_struct_cols()} FROM inc)""",
    """inc_e AS (
      SELECT h.* EXCLUDE (incident_type, victim, impact, root_cause, is_fixed, score),
             f.seq IS NOT NULL AS ai_enriched,
             CASE WHEN f.seq IS NOT NULL THEN f.incident_type ELSE h.incident_type END AS incident_type,
             CASE WHEN f.seq IS NOT NULL THEN f.victim ELSE h.victim END AS victim,
             CASE WHEN f.seq IS NOT NULL THEN f.impact ELSE h.impact END AS impact,
             CASE WHEN f.seq IS NOT NULL THEN f.root_cause ELSE h.root_cause END AS root_cause,
             CASE WHEN f.seq IS NOT NULL THEN f.is_fixed ELSE h.is_fixed END AS is_fixed,
             CASE WHEN f.seq IS NOT NULL THEN f.severity_rationale ELSE '' END AS severity_rationale,
             CASE WHEN f.seq IS NOT NULL THEN f.ai_score_boost ELSE 0.0 END AS ai_score_boost,
             CASE WHEN f.seq IS NOT NULL THEN least(h.score + f.ai_score_boost, 100.0) ELSE h.score END AS score
      FROM inc_h h LEFT JOIN en_fields f ON f.seq = h.seq)""",
]


def _enriched(spark, sf):
    items = _items(spark, sf)
    _, cand, _ = incident_candidates(items, NOW, days=INCIDENT_DAYS, min_score=MIN_SCORE, threshold=THRESHOLD)
    return enrich(cand, derived_responses(items))


@register(
    "enrichment_left_join",
    _with(*_ENRICHED_BASE)
    + "\nSELECT seq, ai_enriched, incident_type, victim, impact, root_cause, is_fixed, severity_rationale, ai_score_boost FROM inc_e",
)
def q_enrichment_join(spark, sf):
    out, _ = _enriched(spark, sf)
    return out.select(
        "seq", "ai_enriched", "incident.incident_type", "incident.victim", "incident.impact", "incident.root_cause",
        "incident.is_fixed", "incident.severity_rationale", "incident.ai_score_boost",
    )


@register("apply_boost", _with(*_ENRICHED_BASE) + "\nSELECT seq, score FROM inc_e")
def q_apply_boost(spark, sf):
    out, _ = _enriched(spark, sf)
    return out.select("seq", "score")


@register(
    "enrichment_stats",
    _with(*_ENRICHED_BASE)
    + """
    SELECT count(*) AS total, count(*) FILTER (WHERE ai_enriched) AS ai_success,
           count(*) - count(*) FILTER (WHERE ai_enriched) AS heuristic_fallback,
           (count(*) > 0 AND count(*) FILTER (WHERE ai_enriched) = 0) AS all_failed,
           NOT (count(*) > 0 AND count(*) FILTER (WHERE ai_enriched) = 0) AS ai_mode
    FROM inc_e""",
)
def q_enrichment_stats(spark, sf):
    return _enriched(spark, sf)[1]


@register(
    "incident_report_enriched",
    _with(*_ENRICHED_BASE)
    + _incident_sql_rows(
        "inc_e",
        rationale="CASE WHEN (SELECT count(*) FILTER (WHERE ai_enriched) FROM inc_e) > 0 AND ai_enriched THEN severity_rationale ELSE '' END",
        ai="ai_enriched",
    ),
)
def q_incident_report_enriched(spark, sf):
    items = _items(spark, sf)
    rep = incident_report_enriched(items, derived_responses(items), NOW, days=INCIDENT_DAYS, min_score=MIN_SCORE, threshold=THRESHOLD)
    return _incident_rows(rep)


@register(
    "enrichment_request",
    _with(NI)
    + f"\nSELECT seq, printf({O.q(E.REQUEST_TEMPLATE)}, title, substr(coalesce(text, ''), 1, {C.ENRICH_DESC_MAX})) AS request FROM news_items JOIN documents ON doc_id = seq",
)
def q_enrichment_request(spark, sf):
    whole = read_table(spark, sf, "documents", ["doc_id", "text"])
    it = _items(spark, sf).select("seq", "title").join(whole, F.col("doc_id") == F.col("seq"))
    return it.select("seq", E.enrichment_request(F.col("title"), F.col("text")).alias("request"))


# ---------------------------------------------------------------- sources (SRC1–SRC8) and their scalars



from ..sources import feeds as SRC  # noqa: E402
from ..sources.run import run_sources  # noqa: E402
from ..sources.tables import read_table  # noqa: E402

_PAGES_ENTRIES = f"""pe AS (
      SELECT page_id AS seq, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS t, url AS link,
             regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1) AS summ FROM pages)"""
_SAFE = r"'^(?i)https?://[^/?#]+'"


@register(
    "read_rss",
    _with(_PAGES_ENTRIES)
    + f"""
    SELECT seq, {O.py_strip('t')} AS title, {O.py_strip('link')} AS url, {O.NOW_SQL} AS published,
           substr(regexp_replace({O.py_strip("regexp_replace(summ, '<[^>]+>', ' ', 'g')")}, '{O.PY_WS}+', ' ', 'g'), 1, {C.DESCRIPTION_MAX}) AS description
    FROM pe WHERE {O.py_strip('t')} <> '' AND regexp_matches({O.py_strip('link')}, {_SAFE})""",
)
def q_read_rss(spark, sf):
    entries = SRC.pages_as_entries(read_table(spark, sf, "pages", ["page_id", "url", "html"]))
    items = SRC.rss_items(entries, "pages", "blogs", 2, None, NOW)
    return items.select("seq", "title", "url", "published", "description")


@register(
    "strip_html",
    _with(_PAGES_ENTRIES) + f"\nSELECT seq, {O.py_strip("regexp_replace(summ, '<[^>]+>', ' ', 'g')")} AS text FROM pe",
)
def q_strip_html(spark, sf):
    e = SRC.pages_as_entries(read_table(spark, sf, "pages", ["page_id", "url", "html"]))
    return e.select("seq", T.strip_html("summary").alias("text"))


@register(
    "collapse_truncate",
    _with(_PAGES_ENTRIES)
    + f"\nSELECT seq, substr(regexp_replace({O.py_strip("regexp_replace(summ, '<[^>]+>', ' ', 'g')")}, '{O.PY_WS}+', ' ', 'g'), 1, {C.DESCRIPTION_MAX}) AS text FROM pe",
)
def q_collapse(spark, sf):
    e = SRC.pages_as_entries(read_table(spark, sf, "pages", ["page_id", "url", "html"]))
    return e.select("seq", T.collapse_truncate(T.strip_html("summary")).alias("text"))


@register("safe_url_filter", f"SELECT page_id, url FROM pages WHERE regexp_matches(url, {_SAFE})")
def q_safe_url_filter(spark, sf):
    return FL.safe_url_filter(read_table(spark, sf, "pages", ["page_id", "url"]))


@register("safe_url", f"SELECT page_id, CASE WHEN regexp_matches(url, {_SAFE}) THEN url END AS safe FROM pages")
def q_safe_url(spark, sf):
    return read_table(spark, sf, "pages", ["page_id", "url"]).select("page_id", T.safe_url("url").alias("safe"))


@register(
    "required_fields",
    _with(_PAGES_ENTRIES) + f"\nSELECT seq FROM pe WHERE {O.py_strip('t')} <> '' AND regexp_matches({O.py_strip('link')}, {_SAFE})",
)
def q_required_fields(spark, sf):
    e = SRC.pages_as_entries(read_table(spark, sf, "pages", ["page_id", "url", "html"]))
    e = e.select("seq", T.py_strip("title").alias("title"), T.safe_url(T.py_strip("link")).alias("url"))
    return FL.required_fields(e).select("seq")


_CVE_EVENTS_SQL = """ce AS (
      SELECT event_id, CASE WHEN event_id % 23 = 0 THEN concat('GHSA-', CAST(user_id AS VARCHAR))
             ELSE concat('CVE-', CAST(2010 + event_id % 16 AS VARCHAR), '-', lpad(CAST(user_id AS VARCHAR), greatest(4, length(CAST(user_id AS VARCHAR)))::INT, '0')) END AS cve_id
      FROM events)"""


def _padded(col: str, n: int):
    """A number as text of at least ``n`` digits; longer ones stay whole."""
    x = F.col(col).cast("string")
    return F.lpad(x, F.greatest(F.lit(n), F.length(x)), F.lit("0"))


@register(
    "legacy_cve_filter",
    _with(_CVE_EVENTS_SQL)
    + f"\nSELECT event_id, cve_id FROM ce WHERE NOT regexp_matches(cve_id, '^CVE-[0-9]{{4}}-') OR CAST(substr(cve_id, 5, 4) AS INT) >= {C.KEV_MIN_CVE_YEAR}",
)
def q_legacy_cve(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "user_id"])
    ce = ev.select(
        "event_id",
        F.when(F.col("event_id") % 23 == 0, F.concat(F.lit("GHSA-"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("CVE-"), (F.lit(2010) + F.col("event_id") % 16).cast("string"), F.lit("-"), _padded("user_id", 4)))
        .alias("cve_id"),
    )
    return FL.legacy_cve(ce, "cve_id")


@register(
    "parse_timestamp",
    "SELECT event_id, ts AS iso, date_trunc('second', ts) AS rfc, date_trunc('day', ts) AS day, date_trunc('second', ts) AS epoch FROM events",
)
def q_parse_timestamp(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "ts"]).withColumn("t", F.col("ts").cast("timestamp"))
    s = ev.select(
        "event_id",
        F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("s_iso"),
        F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("s_rfc"),
        F.date_format("t", "yyyy-MM-dd").alias("s_day"),
        F.unix_seconds("t").alias("s_epoch"),
    )
    return s.select(
        "event_id",
        SRC.parse_iso(F.col("s_iso")).cast("timestamp_ntz").alias("iso"),
        SRC.parse_rfc822(F.col("s_rfc")).cast("timestamp_ntz").alias("rfc"),
        SRC.parse_day(F.col("s_day")).cast("timestamp_ntz").alias("day"),
        F.timestamp_seconds("s_epoch").cast("timestamp_ntz").alias("epoch"),
    )


# NVD records derived from the item table, serialised to JSON and parsed back
def _nvd_records(spark, sf, items: DataFrame | None = None) -> DataFrame:
    it = _items(spark, sf) if items is None else items
    cid = F.concat(F.lit("CVE-2024-"), _padded("seq", 5))
    metric = F.array(F.struct(F.struct(F.col("cvss_score").alias("baseScore")).alias("cvssData")))
    empty = F.array().cast(SRC._METRIC)
    metrics = F.struct(
        F.when(F.col("seq") % 4 == 1, metric).when(F.col("seq") % 4 == 2, empty).alias("cvssMetricV31"),
        F.when(F.col("seq") % 4 == 2, metric).alias("cvssMetricV30"),
        F.when(F.col("seq") % 4 == 3, F.array(F.struct(F.struct(F.lit(None).cast("double").alias("baseScore")).alias("cvssData")))).alias("cvssMetricV2"),
    )
    descs = F.when(
        F.col("seq") % 3 == 0,
        F.array(F.struct(F.lit("es").alias("lang"), F.lit("hola").alias("value")), F.struct(F.lit("en").alias("lang"), F.col("description").alias("value"))),
    ).otherwise(F.array(F.struct(F.lit("en").alias("lang"), F.col("description").alias("value"))))
    pub = F.when(F.col("seq") % 5 == 0, F.lit("not a date")).otherwise(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    v = F.struct(F.struct(cid.alias("id"), pub.alias("published"), descs.alias("descriptions"), metrics.alias("metrics")).alias("cve"))
    js = it.select("seq", F.to_json(v).alias("j"))
    return js.select("seq", F.from_json("j", SRC.NVD_VULN_SCHEMA).alias("v"))


@register(
    "read_nvd",
    _with(NI)
    + f"""
    SELECT seq,
           CASE WHEN length(d) > 0 THEN concat(cid, ': ', substr(d, 1, {C.NVD_TITLE_DESC_MAX}), CASE WHEN length(d) > {C.NVD_TITLE_DESC_MAX} THEN '...' ELSE '' END) ELSE cid END AS title,
           concat('https://nvd.nist.gov/vuln/detail/', cid) AS url,
           CASE WHEN seq % 5 = 0 THEN {O.NOW_SQL} ELSE date_trunc('millisecond', published) END AS published,
           d AS description,
           CASE seq % 4 WHEN 1 THEN coalesce(cvss_score, 0.0) WHEN 2 THEN coalesce(cvss_score, 0.0) WHEN 3 THEN 0.0 ELSE NULL END AS cvss_score,
           cid AS cve
    FROM (SELECT *, concat('CVE-2024-', lpad(CAST(seq AS VARCHAR), greatest(5, length(CAST(seq AS VARCHAR)))::INT, '0')) AS cid, substr(description, 1, {C.DESCRIPTION_MAX}) AS d FROM news_items)""",
)
def q_read_nvd(spark, sf):
    out = SRC.nvd_items(_nvd_records(spark, sf), "NVD", "cve", 1, NOW)
    return out.select("seq", "title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "description", "cvss_score", F.col("cve_ids")[0].alias("cve"))


@register(
    "cvss_metric_pick",
    _with(NI) + "\nSELECT seq, CASE seq % 4 WHEN 1 THEN coalesce(cvss_score, 0.0) WHEN 2 THEN coalesce(cvss_score, 0.0) WHEN 3 THEN 0.0 ELSE NULL END AS cvss FROM news_items",
)
def q_cvss_pick(spark, sf):
    return _nvd_records(spark, sf).select("seq", SRC.cvss_metric_pick(F.col("v.cve.metrics")).alias("cvss"))


@register(
    "cve_title",
    _with(NI)
    + f"""
    SELECT seq, CASE WHEN length(d) > 0 THEN concat(cid, ': ', substr(d, 1, {C.NVD_TITLE_DESC_MAX}), CASE WHEN length(d) > {C.NVD_TITLE_DESC_MAX} THEN '...' ELSE '' END) ELSE cid END AS title
    FROM (SELECT seq, concat('CVE-2024-', lpad(CAST(seq AS VARCHAR), greatest(5, length(CAST(seq AS VARCHAR)))::INT, '0')) AS cid, substr(description, 1, {C.DESCRIPTION_MAX}) AS d FROM news_items)""",
)
def q_cve_title(spark, sf):
    return SRC.nvd_items(_nvd_records(spark, sf), "NVD", "cve", 1, NOW).select("seq", "title")


# KEV rows derived from the item table
_KEV_DERIVED = f"""kv AS (
      SELECT seq, concat('CVE-', CAST(2014 + seq % 8 AS VARCHAR), '-', lpad(CAST(seq AS VARCHAR), greatest(5, length(CAST(seq AS VARCHAR)))::INT, '0')) AS cid,
             source_name AS vendor, source_category AS product, title AS vname,
             substr(description, 1, {C.DESCRIPTION_MAX}) AS d,
             CASE WHEN seq % 7 = 0 THEN NULL ELSE date_trunc('day', published) END AS added,
             CASE WHEN seq % 3 = 0 THEN '' ELSE strftime(date_trunc('day', published) + INTERVAL 21 DAY, '%Y-%m-%d') END AS due
      FROM news_items)"""


def _kev_rows(spark, sf, items: DataFrame | None = None) -> DataFrame:
    it = _items(spark, sf) if items is None else items
    k = F.struct(
        F.concat(F.lit("CVE-"), (F.lit(2014) + F.col("seq") % 8).cast("string"), F.lit("-"), _padded("seq", 5)).alias("cveID"),
        F.col("source_name").alias("vendorProject"),
        F.col("source_category").alias("product"),
        F.col("title").alias("vulnerabilityName"),
        F.col("description").alias("shortDescription"),
        F.when(F.col("seq") % 7 == 0, F.lit("bad")).otherwise(F.date_format("published", "yyyy-MM-dd")).alias("dateAdded"),
        F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.date_format(F.date_add(F.to_date("published"), 21), "yyyy-MM-dd")).alias("dueDate"),
    )
    js = it.select("seq", F.to_json(k).alias("j"))
    return js.select("seq", F.from_json("j", SRC.KEV_VULN_SCHEMA).alias("k"))


_KEV_CUTOFF = "2024-01-17 00:00:00"


@register(
    "read_kev",
    _with(NI, _KEV_DERIVED)
    + f"""
    SELECT seq, concat('[CISA KEV] ', cid, ' — ', vendor, ' ', product, ': ', vname) AS title,
           coalesce(added, {O.NOW_SQL}) AS published,
           CASE WHEN due <> '' THEN concat('Patch required by ', due, '. Actively exploited in the wild. Patch is available. ', d)
                ELSE concat('Actively exploited in the wild. Patch is available. ', d) END AS description
    FROM kv WHERE coalesce(added, {O.NOW_SQL}) >= TIMESTAMP '{_KEV_CUTOFF}' AND CAST(substr(cid, 5, 4) AS INT) >= {C.KEV_MIN_CVE_YEAR}""",
)
def q_read_kev(spark, sf):
    out = SRC.kev_items(_kev_rows(spark, sf), "KEV", "advisories", 1, _KEV_CUTOFF, NOW)
    return out.select("seq", "title", F.col("published").cast("timestamp_ntz").alias("published"), "description")


@register(
    "kev_description",
    _with(NI, _KEV_DERIVED)
    + """
    SELECT seq, CASE WHEN due <> '' THEN concat('Patch required by ', due, '. Actively exploited in the wild. Patch is available. ', d)
                ELSE concat('Actively exploited in the wild. Patch is available. ', d) END AS description FROM kv""",
)
def q_kev_description(spark, sf):
    k = _kev_rows(spark, sf)
    return k.select("seq", SRC.kev_description(F.col("k.dueDate"), F.substring(F.col("k.shortDescription"), 1, C.DESCRIPTION_MAX)).alias("description"))


# OSV records derived from the item table
_ECOS = ["PyPI", "npm", "Go", "Maven", "RubyGems", "crates.io", "NuGet"]


def _osv_records(spark, sf, items: DataFrame | None = None) -> DataFrame:
    it = _items(spark, sf) if items is None else items
    eco = F.element_at(F.array(*[F.lit(e) for e in _ECOS]), (F.col("seq") % len(_ECOS) + 1).cast("int"))
    vid = F.concat(F.lit("GHSA-"), _padded("seq", 6))
    iso = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    sev = F.when(F.col("seq") % 5 == 0, F.array(
        F.struct(F.lit("CVSS_V2").alias("type"), F.lit("AV:N/BS:5.0").alias("score")),
        F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N").alias("score")),
        F.struct(F.lit("CVSS_V4").alias("type"), F.lit("BS:9.9").alias("score")),
    )).when(F.col("cvss_score").isNotNull(), F.array(
        F.struct(F.lit("CVSS_V3").alias("type"), F.concat(F.lit("CVSS:3.1/AV:N/BS:"), F.col("cvss_score").cast("string")).alias("score"))
    ))
    r = F.struct(
        vid.alias("id"),
        F.when(F.col("seq") % 5 != 1, F.col("title")).alias("summary"),
        F.col("description").alias("details"),
        F.concat(F.col("cve_ids"), F.array(F.lit("cve-lower"), vid)).alias("aliases"),
        F.when(F.col("seq") % 6 == 0, F.lit(None)).when(F.col("seq") % 6 == 1, F.lit("garbage")).otherwise(iso).alias("modified"),
        iso.alias("published"),
        sev.alias("severity"),
    )
    js = it.select("seq", eco.alias("ecosystem"), F.concat(vid, F.lit(".json")).alias("filename"), F.to_json(r).alias("j"))
    return js.select("seq", F.from_json("j", SRC.OSV_SCHEMA).alias("r"), "ecosystem", "filename")


_OSV_CUTOFF = "2024-01-10 00:00:00"
_OSV_SQL = _with(
    NI,
    f"""ov AS (
      SELECT seq, ({'[' + ', '.join(O.q(e) for e in _ECOS) + ']'})[1 + seq % {len(_ECOS)}] AS ecosystem,
             concat('GHSA-', lpad(CAST(seq AS VARCHAR), greatest(6, length(CAST(seq AS VARCHAR)))::INT, '0')) AS vid, title, description, cve_ids, cvss_score, published
      FROM news_items WHERE seq % 6 <> 1 AND published >= TIMESTAMP '{_OSV_CUTOFF}')""",
) + f"""
    SELECT seq, CASE WHEN seq % 5 <> 1 AND title <> '' THEN concat(vid, ': ', title) ELSE vid END AS title,
           concat('https://osv.dev/vulnerability/', vid) AS url, published,
           substr(description, 1, {C.DESCRIPTION_MAX}) AS description,
           CASE WHEN seq % 5 = 0 THEN NULL ELSE cvss_score END AS cvss_score,
           array_to_string(cve_ids, ',') AS cves
    FROM ov
    QUALIFY row_number() OVER (PARTITION BY ecosystem ORDER BY vid DESC) <= {C.OSV_MAX_PER_ECOSYSTEM}"""


@register("read_osv", _OSV_SQL)
def q_read_osv(spark, sf):
    out = SRC.osv_items(_osv_records(spark, sf), "OSV", "cve", 1, _OSV_CUTOFF)
    return out.select("seq", "title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "description", "cvss_score", F.array_join("cve_ids", ",").alias("cves"))


@register(
    "latest_per_ecosystem",
    _OSV_SQL.split("\n    SELECT seq, CASE")[0]
    + f"\nSELECT ecosystem, seq FROM ov QUALIFY row_number() OVER (PARTITION BY ecosystem ORDER BY vid DESC) <= {C.OSV_MAX_PER_ECOSYSTEM}",
)
def q_latest_per_ecosystem(spark, sf):
    rec = _osv_records(spark, sf)
    out = SRC.osv_items(rec, "OSV", "cve", 1, _OSV_CUTOFF)
    return out.join(rec.select("seq", "ecosystem"), "seq").select("ecosystem", "seq")


@register(
    "cvss_vector_score",
    _with(NI) + "\nSELECT seq, CASE WHEN seq % 5 = 0 THEN NULL ELSE cvss_score END AS cvss FROM news_items",
)
def q_cvss_vector(spark, sf):
    return _osv_records(spark, sf).select("seq", SRC.cvss_vector_score(F.col("r.severity")).alias("cvss"))


@register("cve_aliases", _with(NI) + "\nSELECT seq, array_to_string(cve_ids, ',') AS cves FROM news_items")
def q_cve_aliases(spark, sf):
    return _osv_records(spark, sf).select("seq", F.array_join(SRC.cve_aliases(F.col("r.aliases")), ",").alias("cves"))


# Archive manifest derived from pages
_MANIFEST_SQL = """mf AS (
      SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS ecosystem,
             CASE WHEN page_id % 13 = 0 THEN concat('../', page_id, '.json')
                  WHEN page_id % 17 = 0 THEN concat('/abs/', page_id, '.json')
                  WHEN page_id % 19 = 0 THEN concat('a\\..\\', page_id, '.json')
                  WHEN page_id % 11 = 0 THEN concat('docs/', page_id, '.txt')
                  ELSE concat('vulns/', page_id, '.json') END AS filename,
             CAST(length(html) AS BIGINT) * CASE regexp_extract(url, '/([a-z]{2})/', 1) WHEN 'fr' THEN 20000 ELSE 600 END AS file_size
      FROM pages)"""


def _manifest(spark, sf) -> DataFrame:
    p = read_table(spark, sf, "pages", ["page_id", "url", "html"])
    eco = F.regexp_extract("url", r"/([a-z]{2})/", 1)
    pid = F.col("page_id").cast("string")
    fn = (
        F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("../"), pid, F.lit(".json")))
        .when(F.col("page_id") % 17 == 0, F.concat(F.lit("/abs/"), pid, F.lit(".json")))
        .when(F.col("page_id") % 19 == 0, F.concat(F.lit("a\\..\\"), pid, F.lit(".json")))
        .when(F.col("page_id") % 11 == 0, F.concat(F.lit("docs/"), pid, F.lit(".txt")))
        .otherwise(F.concat(F.lit("vulns/"), pid, F.lit(".json")))
    )
    size = F.length("html").cast("long") * F.when(eco == "fr", F.lit(20000)).otherwise(F.lit(600))
    return p.select("page_id", eco.alias("ecosystem"), fn.alias("filename"), size.alias("file_size"))


@register(
    "archive_manifest_guard",
    _with(_MANIFEST_SQL, "tot AS (SELECT ecosystem, sum(file_size) AS t FROM mf GROUP BY ecosystem)")
    + f"""
    SELECT page_id, m.ecosystem, filename, file_size FROM mf m JOIN tot USING (ecosystem)
    WHERE tot.t <= {C.OSV_MAX_TOTAL_BYTES} AND NOT starts_with(filename, '/')
      AND NOT list_contains(string_split(replace(filename, '\\', '/'), '/'), '..')
      AND file_size <= {C.OSV_MAX_MEMBER_BYTES} AND ends_with(filename, '.json')""",
)
def q_manifest_guard(spark, sf):
    return SRC.archive_manifest_guard(_manifest(spark, sf)).select("page_id", "ecosystem", "filename", "file_size")


# ---------------------------------------------------------------- filters over the item store

def _store(spark, sf) -> str:
    path = _landed(spark, "store")
    write_items(_items(spark, sf), path)
    return path


@register("stored_lookback", ORACLES["lookback_filter"])
def q_stored_lookback(spark, sf):
    return read_items(spark, _store(spark, sf), NOW, INCIDENT_DAYS * 24).select("seq", "published")


@register(
    "stored_categories",
    _with(NI, "on_now AS (SELECT DISTINCT CASE CAST(substr(source, 4, 10) AS INT) % 6 "
          + " ".join(f"WHEN {i} THEN {O.q(c)}" for i, c in enumerate(CATEGORY_BY_MOD6))
          + " END AS c FROM documents WHERE CAST(substr(source, 4, 10) AS INT) % 6 IN (1, 4))")
    + "\nSELECT seq, source_category FROM news_items WHERE source_category IN (SELECT c FROM on_now)",
)
def q_stored_categories(spark, sf):
    registry = _landed(spark, "landing")
    n = F.substring("name", 4, 10).cast("int") % 6
    # a registry file in which only two categories have enabled sources
    _registry(spark, sf).withColumn("enabled", n.isin(1, 4)).write.parquet(registry)
    return of_active_categories(read_items(spark, _store(spark, sf)), spark.read.parquet(registry)).select("seq", "source_category")


# ---------------------------------------------------------------- dictionaries as tables

_TERMS_SQL = """terms AS (
      SELECT DISTINCT term FROM (
        SELECT lower(p_name) AS term FROM part UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part
        UNION ALL SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) FROM benchmark) WHERE length(term) >= 4),
    listed AS (SELECT list(term) AS ts FROM terms),
    low AS (SELECT doc_id, lower(text) AS t FROM documents)"""


def _terms(spark, sf) -> DataFrame:
    names = read_table(spark, sf, "part", ["p_name"]).select(F.lower("p_name").alias("term"))
    words = names.select(F.explode(F.split("term", " ")).alias("term"))
    passages = read_table(spark, sf, "benchmark", ["text"]).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
    return names.unionByName(words).unionByName(passages).where(F.length("term") >= 4)


@register(
    "dictionary_match",
    _with(_TERMS_SQL)
    + """
    SELECT doc_id, len(h)::INT AS n_terms, md5(array_to_string(list_sort(h), '|')) AS terms_md5
    FROM (SELECT doc_id, list_filter(ts, lambda x: contains(t, x)) AS h FROM low, listed) WHERE len(h) > 0""",
)
def q_dictionary_match(spark, sf):
    hits = dictionary_hits(read_table(spark, sf, "documents", ["doc_id", "text"]), _terms(spark, sf), "text")
    return hits.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("terms_md5"))


@register("dictionary_filter", _with(_TERMS_SQL) + "\nSELECT doc_id FROM low WHERE EXISTS (SELECT 1 FROM terms WHERE contains(t, term) AND length(term) >= 14)")
def q_dictionary_filter(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return rows_with_terms(docs, _terms(spark, sf).where(F.length("term") >= 14), "text", "doc_id").select("doc_id")


# News-aggregator stories derived from the item table
_HN_CUTOFF = "2024-01-01 00:00:00"


def _story_rows(spark, sf, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked ids, stories) of the aggregator."""
    it = _items(spark, sf) if items is None else items
    ranked = R.order_index(it.select("seq", "hn_points"), [F.desc("hn_points"), F.asc("seq")], "r").select(
        F.col("seq").alias("id"), (F.col("r") - 1).alias("rank")
    )
    items = it.select(
        F.col("seq").alias("id"),
        F.when(F.col("seq") % 9 == 0, F.lit("comment")).otherwise(F.lit("story")).alias("type"),
        "title",
        F.unix_seconds("published").alias("time"),
        F.when(F.col("seq") % 10 == 0, F.lit("ftp://x")).otherwise(F.col("url")).alias("url"),
        F.col("hn_points").alias("score"),
        (F.col("seq") % 50).cast("int").alias("descendants"),
    )
    return ranked, items


def _hn(spark, sf) -> DataFrame:
    return SRC.hn_items(*_story_rows(spark, sf), "HN", "community", 2, _HN_CUTOFF)


_HN_SQL = _with(NI, "r AS (SELECT *, row_number() OVER (ORDER BY hn_points DESC, seq) - 1 AS rank FROM news_items)") + f"""
    SELECT seq, {O.py_strip('title')} AS title,
           CASE WHEN seq % 10 = 0 THEN concat('https://news.ycombinator.com/item?id=', seq) ELSE url END AS url,
           concat('HackerNews | ', hn_points, ' points | ', seq % 50, ' comments') AS description, hn_points
    FROM r
    WHERE rank < {C.HN_TOP_STORIES} AND seq % 9 <> 0 AND {O.py_strip('title')} <> ''
      AND {O.contains_any('lower(title)', C.HN_SECURITY_TERMS)}
      AND date_trunc('second', published) >= TIMESTAMP '{_HN_CUTOFF}'
    ORDER BY rank LIMIT {C.HN_MAX_ITEMS}"""


@register("read_hn", _HN_SQL)
def q_read_hn(spark, sf):
    return _hn(spark, sf).select("seq", "title", "url", "description", "hn_points")


@register("hn_scan_limit", _HN_SQL.replace(f"SELECT seq, {O.py_strip('title')} AS title,", "SELECT seq, rank,").replace(
    "CASE WHEN seq % 10 = 0 THEN concat('https://news.ycombinator.com/item?id=', seq) ELSE url END AS url,\n           concat('HackerNews | ', hn_points, ' points | ', seq % 50, ' comments') AS description, hn_points", "hn_points"))
def q_hn_scan_limit(spark, sf):
    it = _items(spark, sf)
    ranked = R.order_index(it.select("seq", "hn_points"), [F.desc("hn_points"), F.asc("seq")], "r").select("seq", (F.col("r") - 1).alias("rank"))
    return _hn(spark, sf).select("seq", "hn_points").join(ranked, "seq").select("seq", "rank", "hn_points")


# Generic JSON feeds: one document for each source and range of ids, so documents stay small and all items are in one
_FEED_IDS = 1200


def _feed_docs(spark, sf, items: DataFrame | None = None) -> DataFrame:
    it = (_items(spark, sf) if items is None else items).withColumn("n", F.substring("source_name", 4, 10).cast("long"))
    it = it.withColumn("feed_id", F.floor(F.col("seq") / F.lit(_FEED_IDS)) * 1000 + F.col("n"))
    iso = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    entry = F.to_json(
        F.struct(
            F.when(F.col("seq") % 7 != 0, F.col("title")).alias("title"),
            F.when(F.col("seq") % 7 == 0, F.col("title")).alias("name"),
            F.when(F.col("seq") % 5 != 0, F.col("url")).alias("url"),
            F.when(F.col("seq") % 5 == 0, F.col("url")).alias("link"),
            F.when(F.col("seq") % 4 != 0, F.col("description")).alias("description"),
            F.when(F.col("seq") % 4 == 0, F.col("description")).alias("body"),
            F.when(F.col("seq") % 6 != 0, iso).alias("published_at"),
            F.when(F.col("seq") % 6 == 0, iso).alias("updated_at"),
        )
    )
    docs = it.groupBy("feed_id", "n").agg(F.array_sort(F.collect_list(F.struct("seq", entry.alias("j")))).alias("es"))
    arr = F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["j"]), ","), F.lit("]"))
    text = (
        F.when(F.col("n") % 3 == 0, arr)
        .when(F.col("n") % 3 == 1, F.concat(F.lit('{"items": '), arr, F.lit("}")))
        .otherwise(F.concat(F.lit('{"meta": 1, "data": '), arr, F.lit("}")))
    )
    return docs.select("feed_id", text.alias("text"))


_FEED_CTE = f"""fr AS (
      SELECT *, (seq // {_FEED_IDS}) * 1000 + CAST(substr(source_name, 4, 10) AS BIGINT) AS n,
             row_number() OVER (PARTITION BY source_name, seq // {_FEED_IDS} ORDER BY seq) - 1 AS pos
      FROM news_items QUALIFY pos < {C.JSON_FEED_MAX_RAW})"""
_FEED_SQL = _with(NI, _FEED_CTE)


@register(
    "read_json_feed",
    _FEED_SQL
    + f"""
    SELECT n * 1000 + pos AS seq, {O.py_strip('title')} AS title, {O.py_strip('url')} AS url, published,
           substr({O.py_strip("regexp_replace(description, '<[^>]+>', ' ', 'g')")}, 1, {C.DESCRIPTION_MAX}) AS description
    FROM fr WHERE {O.py_strip('title')} <> '' AND regexp_matches({O.py_strip('url')}, {_SAFE})""",
)
def q_read_json_feed(spark, sf):
    out = SRC.json_feed_items(_feed_docs(spark, sf), "feed", "blogs", 2, None, NOW)
    return out.select("seq", "title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "description")


@register("first_n_per_feed", _FEED_SQL + "\nSELECT n AS feed, pos FROM fr")
def q_first_n_per_feed(spark, sf):
    out = SRC.json_feed_items(_feed_docs(spark, sf), "feed", "blogs", 2, None, NOW)
    return out.select(F.floor(F.col("seq") / 1000).alias("feed"), (F.col("seq") % 1000).alias("pos"))


# Source registry derived from the distinct sources of ``documents``
_REG_TYPES = ["rss", "nvd_api", "osv_api", "hn_api", "json_api", "json_api", "smtp"]


def _registry(spark, sf) -> DataFrame:
    d = read_table(spark, sf, "documents", ["source"]).distinct()
    n = F.substring("source", 4, 10).cast("int")
    from ..sources.tables import CATEGORY_BY_MOD6

    return d.select(
        F.element_at(F.array(*[F.lit(c) for c in CATEGORY_BY_MOD6]), (n % 6 + 1)).alias("category"),
        F.col("source").alias("name"),
        F.element_at(F.array(*[F.lit(t) for t in _REG_TYPES]), (n % len(_REG_TYPES) + 1)).alias("type"),
        F.when(n % 2 == 0, F.concat(F.lit("https://www.cisa.gov/feeds/"), n.cast("string"))).otherwise(F.concat(F.lit("https://feeds.example.com/"), n.cast("string"))).alias("url"),
        F.when(n % 5 == 0, F.lit(None).cast("int")).otherwise((n % 3 + 1).cast("int")).alias("tier"),
        F.when(n % 6 == 0, F.lit(False)).when(n % 6 == 1, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("enabled"),
    )


def _reg_sql() -> str:
    from ..sources.tables import CATEGORY_BY_MOD6

    cats = "[" + ", ".join(O.q(c) for c in CATEGORY_BY_MOD6) + "]"
    types = "[" + ", ".join(O.q(t) for t in _REG_TYPES) + "]"
    return f"""reg AS (
      SELECT {cats}[1 + n % 6] AS category, source AS name, {types}[1 + n % {len(_REG_TYPES)}] AS type,
             CASE WHEN n % 2 = 0 THEN concat('https://www.cisa.gov/feeds/', n) ELSE concat('https://feeds.example.com/', n) END AS url,
             CASE WHEN n % 5 = 0 THEN NULL ELSE 1 + n % 3 END AS tier,
             CASE WHEN n % 6 = 0 THEN false WHEN n % 6 = 1 THEN NULL ELSE true END AS enabled
      FROM (SELECT DISTINCT source, CAST(substr(source, 4, 10) AS INT) AS n FROM documents)),
    active AS (
      SELECT name, category, coalesce(tier, {C.DEFAULT_TIER}) AS tier,
             CASE type WHEN 'rss' THEN 'rss' WHEN 'nvd_api' THEN 'nvd' WHEN 'osv_api' THEN 'osv' WHEN 'hn_api' THEN 'hn'
                       WHEN 'json_api' THEN CASE WHEN contains(lower(url), 'cisa') THEN 'kev' ELSE 'json_feed' END END AS parser
      FROM reg WHERE coalesce(enabled, true))"""


@register("source_registry_dispatch", _with(_reg_sql()) + "\nSELECT name, category, tier, parser FROM active WHERE parser IS NOT NULL")
def q_registry_dispatch(spark, sf):
    return SRC.active_registry(_registry(spark, sf)).select("name", "category", "tier", "parser")


@register(
    "source_registry_join",
    _with(_reg_sql())
    + "\nSELECT d.doc_id, d.source AS source_name, a.category AS source_category, a.tier AS source_tier, a.parser FROM documents d JOIN active a ON a.name = d.source WHERE a.parser IS NOT NULL",
)
def q_registry_join(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "source"]).withColumnRenamed("source", "source_name")
    return SRC.attach_registry(docs, _registry(spark, sf)).select("doc_id", "source_name", "source_category", "source_tier", "parser")


@register(
    "merge_sources",
    _with(NI, _PAGES_ENTRIES)
    + f"""
    SELECT seq, 'documents' AS origin, source_name, title FROM news_items
    UNION ALL
    SELECT seq, 'pages' AS origin, 'pages' AS source_name, {O.py_strip('t')} AS title
    FROM pe WHERE {O.py_strip('t')} <> '' AND regexp_matches({O.py_strip('link')}, {_SAFE})""",
)
def q_merge_sources(spark, sf):
    a = _items(spark, sf).select("seq", F.lit("documents").alias("origin"), "source_name", "title")
    pages = SRC.rss_items(SRC.pages_as_entries(read_table(spark, sf, "pages", ["page_id", "url", "html"])), "pages", "blogs", 2, None, NOW)
    b = pages.select("seq", F.lit("pages").alias("origin"), "source_name", "title")
    return R.merge_sources(a, b)


# ---------------------------------------------------------------- the source run: records landed as files, read by their readers

_RUN_REGISTRY = [
    ("advisories", "KEV", "json_api", "https://www.cisa.gov/kev", 1, True),
    ("blogs", "Feeds", "json_api", "https://feeds.example.com/all", 2, None),
    ("blogs", "Gone", "rss", "https://feeds.example.com/gone", 2, True),
    ("blogs", "Pages", "rss", "https://feeds.example.com/pages", 3, True),
    ("blogs", "Truncated", "json_api", "https://feeds.example.com/truncated", 2, True),
    ("community", "Stories", "hn_api", "https://feeds.example.com/stories", 3, True),
    ("cve", "NVD", "nvd_api", "https://feeds.example.com/nvd", 1, True),
    ("cve", "Off", "nvd_api", "https://feeds.example.com/off", 1, False),
    ("cve", "OSV", "osv_api", "https://feeds.example.com/osv", 1, True),
]
#: Top-stories lists are this long; the reader scans their first 200.
_STORY_LIST = 500


def _landed(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _land_lists(rows: DataFrame, column: str, path: str) -> None:
    """Records as files of the form {"vulnerabilities": [...]}, a bounded number in each."""
    files = rows.withColumn("part", F.floor(F.col("seq") / _FEED_IDS))
    files.groupBy("part").agg(F.to_json(F.struct(F.collect_list(column).alias("vulnerabilities"))).alias("value")).write.partitionBy("part").text(path)


def _land_pages(spark, sf, path: str) -> None:
    """Web pages as RSS (even page_id) and Atom (odd) files; every seventh has no date."""
    e = SRC.pages_as_entries(read_table(spark, sf, "pages", ["page_id", "url", "html"]))
    at = F.when(F.col("seq") % 7 != 0, F.timestamp_seconds(F.lit(1706140800) + F.col("seq") % 6 * 86400 + F.col("seq") % 86400))
    rss = e.where(F.col("seq") % 2 == 0).select("title", "link", F.col("summary").alias("description"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"))
    rss.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    links = F.array(F.struct(F.lit("ftp://x").alias("_href"), F.lit("self").alias("_rel")), F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel")))
    atom = e.where(F.col("seq") % 2 == 1).select("title", "summary", links.alias("link"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"))
    atom.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").mode("append").save(path)


def _land_stories(spark, sf, path: str, items: DataFrame) -> None:
    """The best stories' ids as one list, all stories as lines."""
    ranked, stories = _story_rows(spark, sf, items)
    best = ranked.where(F.col("rank") < _STORY_LIST)
    best.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])).alias("value")).coalesce(1).write.text(f"{path}/ids")
    stories.write.json(f"{path}/items")


_ARCHIVE_IDS = 3000


def _archive_members(spark, sf, items: DataFrame | None = None) -> DataFrame:
    """Records as members of archives of up to ``_ARCHIVE_IDS`` ids; some have unsafe names or hold no record.

    Every third archive of npm holds a filler that takes it over the limit of inflated bytes.
    """
    rec = _osv_records(spark, sf, items)
    name = F.regexp_replace("filename", r"\.json$", "")
    n = F.col("seq")
    member = (
        F.when(n % 13 == 0, F.concat(F.lit("../"), name, F.lit(".json")))
        .when(n % 17 == 0, F.concat(F.lit("/abs/"), name, F.lit(".json")))
        .when(n % 19 == 0, F.concat(F.lit("a\\..\\"), name, F.lit(".json")))
        .when(n % 11 == 0, F.concat(F.lit("vulns/"), name, F.lit(".txt")))
        .otherwise(F.concat(F.lit("vulns/"), name, F.lit(".json")))
    )
    archive = F.floor(n / F.lit(_ARCHIVE_IDS))
    text = F.when(n % 23 == 0, F.lit("{not json")).when(n % 29 == 0, F.lit("[1]")).otherwise(F.to_json("r"))
    rows = rec.select("ecosystem", archive.cast("string").alias("archive"), member.alias("filename"), text.alias("text"), archive.alias("_a"))
    filler = rows.where((F.col("ecosystem") == "npm") & (F.col("_a") % 3 == 1)).select("ecosystem", "archive").distinct()
    blanks = F.repeat(F.lit(" "), C.OSV_MAX_TOTAL_BYTES // 15)
    filler = filler.select("ecosystem", "archive", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("k"), blanks.alias("text"))
    filler = filler.select("ecosystem", "archive", F.concat(F.lit("filler/"), F.col("k"), F.lit(".txt")).alias("filename"), "text")
    return rows.drop("_a").unionByName(filler)


def _land_archives(spark, sf, path: str, items: DataFrame) -> None:
    """The archives, and beside them one that is cut short and one that is no archive."""
    from ..sources.archives import file_system, write_archives

    write_archives(_archive_members(spark, sf, items), path)
    store, root = file_system(path)
    store.create_dir(f"{root}/broken", recursive=True)
    for name, content in (("short", b"PK\x03\x04 cut short"), ("none", b"")):
        with store.open_output_stream(f"{root}/broken/{name}.zip") as f:
            f.write(content)


#: Which records of the archives can be read, as SQL over the derived records ``ov``.
_ARCHIVED = f"""seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 11 <> 0 AND seq % 23 <> 0 AND seq % 29 <> 0
      AND NOT (ecosystem = 'npm' AND (seq // {_ARCHIVE_IDS}) % 3 = 1)"""


@register("read_osv_archives", _OSV_SQL.replace("\n    FROM ov\n", f"\n    FROM ov WHERE {_ARCHIVED}\n").replace("SELECT seq, CASE", "SELECT CASE"))
def q_read_osv_archives(spark, sf):
    path = _landed(spark, "landing")
    # records and fillers both start from the items: they are derived once
    _land_archives(spark, sf, path, cut_lineage(_items(spark, sf)))
    out = SRC.osv_items(SRC.read_osv_archives(spark, path), "OSV", "cve", 1, _OSV_CUTOFF)
    return out.select("title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "description", "cvss_score", F.array_join("cve_ids", ",").alias("cves"))


def _run(spark, sf):
    """Records of all six kinds landed under the shared folder; one source's folder is missing, one is
    switched off, and one holds a compressed file that is cut short, which shows only while it is read."""
    from ..sources.archives import file_system

    base = _landed(spark, "landing")
    items = cut_lineage(_items(spark, sf))  # all kinds of records come from the items: they are derived once
    _land_lists(_kev_rows(spark, sf, items), "k", f"{base}/KEV")
    _land_lists(_nvd_records(spark, sf, items), "v", f"{base}/NVD")
    _feed_docs(spark, sf, items).withColumnRenamed("text", "value").write.partitionBy("feed_id").text(f"{base}/Feeds")
    _land_pages(spark, sf, f"{base}/Pages")
    _land_stories(spark, sf, f"{base}/Stories", items)
    _land_archives(spark, sf, f"{base}/OSV", items)
    store, root = file_system(f"{base}/Truncated")
    store.create_dir(root, recursive=True)
    whole = gzip.compress(json.dumps([{"title": f"Story {i}", "url": f"https://x.example/{i}"} for i in range(5000)]).encode())
    with store.open_output_stream(f"{root}/feed.json.gz", compression=None) as f:
        f.write(whole[: len(whole) // 2])
    registry = spark.createDataFrame(_RUN_REGISTRY, SRC.REGISTRY_SCHEMA)
    return run_sources(spark, registry, base, NOW, 336)


_RUN_HOURS = f"{O.NOW_SQL} - INTERVAL 336 HOUR"
_CID_NVD = "concat('CVE-2024-', lpad(CAST(seq AS VARCHAR), greatest(5, length(CAST(seq AS VARCHAR)))::INT, '0'))"
_NO_CVES = "[]::VARCHAR[]"
_DESC_STRIPPED = f"substr({O.py_strip("regexp_replace(description, '<[^>]+>', ' ', 'g')")}, 1, {C.DESCRIPTION_MAX})"
_PAGE_DESC = f"substr(regexp_replace({O.py_strip("regexp_replace(summ, '<[^>]+>', ' ', 'g')")}, '{O.PY_WS}+', ' ', 'g'), 1, {C.DESCRIPTION_MAX})"
_EPOCH = f"CASE WHEN seq % 7 <> 0 THEN make_timestamp((1706140800 + seq % 6 * 86400 + seq % 86400) * 1000000) ELSE {O.NOW_SQL} END"

#: The union of the run as CTE ``rn``: place in the registry's order, then the item's columns.
_RUN_UNION = f"""rn AS (
      SELECT 0 AS place, 'KEV' AS source_name, 'advisories' AS source_category, 1 AS source_tier,
             concat('[CISA KEV] ', cid, ' — ', vendor, ' ', product, ': ', vname) AS title, '{C.KEV_URL}' AS url, coalesce(added, {O.NOW_SQL}) AS published,
             CASE WHEN due <> '' THEN concat('Patch required by ', due, '. Actively exploited in the wild. Patch is available. ', d)
                  ELSE concat('Actively exploited in the wild. Patch is available. ', d) END AS description,
             {C.KEV_CVSS}::DOUBLE AS cvss_score, [cid] AS cve_ids, 0 AS hn_points
      FROM kv WHERE CAST(substr(cid, 5, 4) AS INT) >= {C.KEV_MIN_CVE_YEAR}
      UNION ALL
      SELECT 1, 'Feeds', 'blogs', 2, t, u, published, d, NULL, {O.cves_expr("concat_ws(' ', t, d)")}, 0
      FROM (SELECT {O.py_strip('title')} AS t, {O.py_strip('url')} AS u, published, {_DESC_STRIPPED} AS d FROM fr) WHERE t <> '' AND regexp_matches(u, {_SAFE})
      UNION ALL
      SELECT 2, 'Pages', 'blogs', 3, t2, u, p, d, NULL, {O.cves_expr("concat_ws(' ', t2, d)")}, 0
      FROM (SELECT {O.py_strip('t')} AS t2, {O.py_strip('link')} AS u, {_EPOCH} AS p, {_PAGE_DESC} AS d FROM pe) WHERE t2 <> '' AND regexp_matches(u, {_SAFE})
      UNION ALL
      SELECT 4, 'Stories', 'community', 3, title, url, published, description, NULL, {_NO_CVES}, hn_points FROM (
        SELECT {O.py_strip('title')} AS title, CASE WHEN seq % 10 = 0 THEN concat('https://news.ycombinator.com/item?id=', seq) ELSE url END AS url,
               date_trunc('second', published) AS published, concat('HackerNews | ', hn_points, ' points | ', seq % 50, ' comments') AS description, hn_points
        FROM (SELECT *, row_number() OVER (ORDER BY hn_points DESC, seq) - 1 AS rank FROM base_items)
        WHERE rank < {C.HN_TOP_STORIES} AND seq % 9 <> 0 AND {O.py_strip('title')} <> '' AND {O.contains_any('lower(title)', C.HN_SECURITY_TERMS)}
          AND date_trunc('second', published) >= {_RUN_HOURS} ORDER BY rank LIMIT {C.HN_MAX_ITEMS})
      UNION ALL
      SELECT 5, 'NVD', 'cve', 1,
             CASE WHEN length(d) > 0 THEN concat(cid, ': ', substr(d, 1, {C.NVD_TITLE_DESC_MAX}), CASE WHEN length(d) > {C.NVD_TITLE_DESC_MAX} THEN '...' ELSE '' END) ELSE cid END,
             concat('https://nvd.nist.gov/vuln/detail/', cid), CASE WHEN seq % 5 = 0 THEN {O.NOW_SQL} ELSE date_trunc('millisecond', published) END, d,
             CASE seq % 4 WHEN 1 THEN coalesce(cvss_score, 0.0) WHEN 2 THEN coalesce(cvss_score, 0.0) WHEN 3 THEN 0.0 ELSE NULL END, [cid], 0
      FROM (SELECT *, {_CID_NVD} AS cid, substr(description, 1, {C.DESCRIPTION_MAX}) AS d FROM base_items)
      UNION ALL
      SELECT 6, 'OSV', 'cve', 1, title, url, published, description, cvss_score, cve_ids, 0 FROM (
        SELECT CASE WHEN seq % 5 <> 1 AND title <> '' THEN concat(vid, ': ', title) ELSE vid END AS title, concat('https://osv.dev/vulnerability/', vid) AS url, published,
               substr(description, 1, {C.DESCRIPTION_MAX}) AS description, CASE WHEN seq % 5 = 0 THEN NULL ELSE cvss_score END AS cvss_score, cve_ids
        FROM ov WHERE {_ARCHIVED} QUALIFY row_number() OVER (PARTITION BY ecosystem ORDER BY vid DESC) <= {C.OSV_MAX_PER_ECOSYSTEM}))"""
_OV_CTE = "ov AS (" + _OSV_SQL.split("ov AS (")[1].split("\n    SELECT seq, CASE")[0].rstrip().rstrip(")") + ")"
_RUN_CTES = [
    cte.replace("news_items", "base_items").replace(f"TIMESTAMP '{_OSV_CUTOFF}'", _RUN_HOURS)
    for cte in (NI, _KEV_DERIVED, _FEED_CTE, _PAGES_ENTRIES, _OV_CTE, _RUN_UNION)
]


@register("source_run", _with(*_RUN_CTES) + f"\nSELECT source_name, title, published FROM rn WHERE published >= {_RUN_HOURS}")
def q_source_run(spark, sf):
    return _run(spark, sf).items.select("source_name", "title", F.col("published").cast("timestamp_ntz").alias("published"))


@register("source_run_errors", "SELECT unnest(['Gone', 'Truncated']) AS source_name")
def q_source_run_errors(spark, sf):
    return _run(spark, sf).errors.select("source_name")


_RUN_ITEMS = f"""news_items AS (
      SELECT * EXCLUDE (place), row_number() OVER (ORDER BY place, url, title, published, description) AS seq FROM rn WHERE published >= {_RUN_HOURS})"""


@register("digest_over_sources", _with(*_RUN_CTES, _RUN_ITEMS, O.window_cte(168, None)) + _DIGEST_SQL.partition(O.window_cte(DIGEST_HOURS, None))[2])
def q_digest_over_sources(spark, sf):
    return _digest_rows(news_digest(_run(spark, sf).items, NOW, hours=168, min_score=MIN_SCORE, threshold=THRESHOLD))


# ---------------------------------------------------------------- streaming (ST1, ST2)

from ..streaming.ingest import run_ingest_dedup, run_report_refresh  # noqa: E402
from ..streaming.winners import current_winners, recorded_copies, stream_in_parts  # noqa: E402


@register("stream_ingest_dedup", _with(NI) + f"\nSELECT DISTINCT {O.fingerprint('title', 'url')} AS fp FROM news_items")
def q_stream_ingest_dedup(spark, sf):
    return run_ingest_dedup(_items(spark, sf)).select("fp")


@register("stream_exact_dedup", _CANON + "\nSELECT fp, seq, source_name, source_tier, pos, n_copies FROM canon")
def q_stream_exact_dedup(spark, sf):
    log = stream_in_parts(_items(spark, sf), _landed(spark, "stream-winners"))
    return current_winners(log).select("fp", "seq", "source_name", "source_tier", "pos", "n_copies")


@register("stream_attribution", ORACLES["dedup_attribution"])
def q_stream_attribution(spark, sf):
    return recorded_copies(stream_in_parts(_items(spark, sf), _landed(spark, "stream-winners"))).select("fp", "seq", "ord", "source_name")


@register("stream_report_refresh", f"SELECT idx, seq, score FROM ({_INCIDENT_SQL}) r")
def q_stream_report_refresh(spark, sf):
    return run_report_refresh(_items(spark, sf), NOW, days=INCIDENT_DAYS, min_score=MIN_SCORE, threshold=THRESHOLD).select("idx", "seq", "score")


# ---------------------------------------------------------------- sinks (SNK1, SNK2), S12, A6 keyword frequencies

def _sink_roundtrip(df: DataFrame, order: list[str]) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex[:12]}"
    R.write_report(df, path, "parquet", order)
    return spark.read.parquet(path)


@register("digest_table", _DIGEST_SQL)
def q_digest_table(spark, sf):
    return _sink_roundtrip(_digest_rows(_digest(spark, sf)), ["cluster_rank", "item_rank"])


@register("incident_table", _INCIDENT_SQL)
def q_incident_table(spark, sf):
    rep = incident_report(_items(spark, sf), NOW, days=INCIDENT_DAYS, min_score=MIN_SCORE, threshold=THRESHOLD)
    return _sink_roundtrip(_incident_rows(rep), ["idx"])


@register(
    "py_title",
    _with(NI)
    + f"""
    SELECT DISTINCT kw, {O.py_title_sql('kw')} AS titled
    FROM (SELECT unnest({O.keywords_expr(O.keyword_text())}) AS kw FROM news_items)""",
)
def q_py_title(spark, sf):
    # written once: a filter on the words, which Spark adds to an explode, would compute them again beside the scan
    k = cut_lineage(with_keywords(_items(spark, sf)).select("keywords")).select(F.explode("keywords").alias("kw")).distinct()
    return k.select("kw", T.py_title("kw").alias("titled"))


@register("cluster_keyword_freq", _TOPIC + "\nSELECT comp, kw, cnt FROM tp_freq")
def q_cluster_kw_freq(spark, sf):
    _, members = cluster(_topic_items(spark, sf))
    return (
        members.where(~F.col("is_other"))
        .select("comp", F.explode(F.array_distinct("keywords")).alias("kw"))
        .groupBy("comp", "kw")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
