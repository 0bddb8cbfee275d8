"""Source readers (SRC1–SRC8): landed feed files → the item table.

Each reader has two layers: a ``read_*`` function that loads landed files
with Spark's own readers (XML, multi-line JSON, text), and a ``*_items``
transform that turns the parsed records into item rows. The transforms are
pure column expressions, so they run the same on files and on records that
Spark derives from other tables. Bad rows become NULLs and are dropped row
by row (``try_*`` functions, PERMISSIVE parsing); a bad feed never fails
the job.

Every reader takes the source's registry columns (name, category, tier)
and a ``cutoff``; ``now`` replaces unparsable dates where the source does so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import text as X
from ..functions.scoring import now_lit
from ..operators import filters as FL
from .archives import read_archives

# ---------------------------------------------------------------- timestamps


ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|z|[+-]\d{2}(:?\d{2})?)?)?$"
# RFC 822 zone names and their offsets
NAMED_ZONES = [
    ("GMT|UT|UTC|Z", "+0000"), ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"),
    ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"),
]


def parse_iso(s: Column) -> Column:
    """ISO-8601 with optional fraction and zone ('Z' = UTC); NULL when unparsable.

    A full date is required: a bare year or a time of day is no timestamp.
    """
    return F.when(F.trim(s).rlike(ISO_SHAPE), F.try_to_timestamp(F.trim(s)))


def parse_rfc822(s: Column) -> Column:
    """RSS dates: weekday in any length, 2- or 4-digit years, offsets and the named zones."""
    body = F.regexp_replace(F.regexp_replace(F.trim(s), r"\s+", " "), r"^[A-Za-z]+\.?,? ?(?=\d)", "")
    body = F.regexp_replace(body, r"^(\d{1,2} [A-Za-z]{3} )([0-5]\d|6[0-8]) ", "$120$2 ")
    body = F.regexp_replace(body, r"^(\d{1,2} [A-Za-z]{3} )(\d{2}) ", "$119$2 ")
    for names, offset in NAMED_ZONES:
        body = F.regexp_replace(body, rf" ({names})$", f" {offset}")
    return F.coalesce(
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm xx")),
    )


def parse_day(s: Column) -> Column:
    """'yyyy-MM-dd' as UTC midnight."""
    return F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))


def _registry_cols(name: str, category: str, tier: int) -> list[Column]:
    return [
        F.lit(name).alias("source_name"),
        F.lit(category).alias("source_category"),
        F.lit(int(tier)).cast("int").alias("source_tier"),
    ]


def _finish(df: DataFrame, cutoff) -> DataFrame:
    out = df.where(F.col("published") >= now_lit(cutoff)) if cutoff is not None else df
    for c, t in [("cvss_score", "double"), ("hn_points", "int")]:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t) if c == "cvss_score" else F.lit(0))
    return out.select(
        "seq", "title", "url", "source_name", "source_category", "source_tier", "published",
        "description", "cvss_score", "cve_ids", "hn_points",
    )


# ---------------------------------------------------------------- RSS / Atom (SRC1)

RSS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["title", "link", "pubDate", "published", "updated", "created", "description", "summary"]]
)


ATOM_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["title", "published", "updated", "created", "summary"]]
    + [T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())])))]
)


def read_rss(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Landed RSS (``item``) or Atom (``entry``) files; entities decoded by the XML reader.

    An Atom entry's link is the ``href`` of its first alternate link (no ``rel`` means alternate).
    """
    atom = row_tag == "entry"
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(ATOM_SCHEMA if atom else RSS_SCHEMA)
    df = reader.load(path)
    if atom:
        alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        df = df.withColumn("link", F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"]))
    return df.withColumn("seq", F.monotonically_increasing_id())


def rss_items(entries: DataFrame, name: str, category: str, tier: int, cutoff, now) -> DataFrame:
    """``entries``: seq, title, link, date strings (pubDate/published/updated/created), summary/description."""
    cols = entries.columns
    date_cols = [c for c in ["published", "pubDate", "updated", "created"] if c in cols]
    parsed = [F.coalesce(parse_rfc822(F.col(c)), parse_iso(F.col(c))) for c in date_cols]
    summary = F.coalesce(*[F.col(c) for c in ["summary", "description"] if c in cols], F.lit(""))
    desc = X.collapse_truncate(X.strip_html(summary))
    title = X.py_strip(F.coalesce(F.col("title"), F.lit("")))
    link = X.safe_url(X.py_strip(F.coalesce(F.col("link"), F.lit(""))))
    out = entries.select(
        "seq",
        title.alias("title"),
        link.alias("url"),
        *_registry_cols(name, category, tier),
        F.coalesce(*parsed, now_lit(now)).alias("published"),
        desc.alias("description"),
    ).withColumn("cve_ids", X.extract_cves(F.concat_ws(" ", "title", "description")))
    return _finish(FL.required_fields(out), cutoff)


def pages_as_entries(pages: DataFrame) -> DataFrame:
    """Web pages as feed entries: <title> text, url, <body> as the summary."""
    return pages.select(
        F.col("page_id").alias("seq"),
        F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.regexp_extract("html", r"(?s)<body[^>]*>(.*)</body>", 1).alias("summary"),
    )


# ---------------------------------------------------------------- NVD (SRC2)

_METRIC = T.ArrayType(T.StructType([T.StructField("cvssData", T.StructType([T.StructField("baseScore", T.DoubleType())]))]))
NVD_VULN_SCHEMA = T.StructType(
    [
        T.StructField(
            "cve",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField("published", T.StringType()),
                    T.StructField(
                        "descriptions",
                        T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("value", T.StringType())])),
                    ),
                    T.StructField(
                        "metrics",
                        T.StructType([T.StructField(k, _METRIC) for k in ["cvssMetricV31", "cvssMetricV30", "cvssMetricV2"]]),
                    ),
                ]
            ),
        )
    ]
)
NVD_FILE_SCHEMA = T.StructType([T.StructField("vulnerabilities", T.ArrayType(NVD_VULN_SCHEMA))])


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(NVD_FILE_SCHEMA).option("multiLine", "true").json(path)
    return df.select(F.posexplode("vulnerabilities").alias("pos", "v")).select(
        F.monotonically_increasing_id().alias("seq"), "v"
    )


def cvss_metric_pick(metrics: Column) -> Column:
    """First non-empty list of V3.1 → V3.0 → V2; element 0's base score, 0.0 when missing."""
    expr = None
    for k in ["cvssMetricV31", "cvssMetricV30", "cvssMetricV2"]:
        lst = metrics[k]
        cond = F.coalesce(F.size(lst), F.lit(0)) > 0
        val = F.coalesce(F.try_element_at(lst, F.lit(1))["cvssData"]["baseScore"], F.lit(0.0))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(None).cast("double"))


def cve_title(cve_id: Column, desc: Column) -> Column:
    """S15: 'ID: first 80 chars...' or the id alone."""
    short = X.truncate_ellipsis(desc, C.NVD_TITLE_DESC_MAX)
    return F.when(F.length(short) > 0, F.concat(cve_id, F.lit(": "), short)).otherwise(cve_id)


def nvd_items(vulns: DataFrame, name: str, category: str, tier: int, now) -> DataFrame:
    """``vulns``: seq, v (struct per NVD_VULN_SCHEMA). No client-side cutoff (the API filters)."""
    cve = F.col("v.cve")
    cid = F.coalesce(cve["id"], F.lit(""))
    en = F.filter(F.coalesce(cve["descriptions"], F.array()), lambda d: d["lang"] == "en")
    desc = F.substring(F.coalesce(F.try_element_at(en, F.lit(1))["value"], F.lit("")), 1, C.DESCRIPTION_MAX)
    out = vulns.select(
        "seq",
        cve_title(cid, desc).alias("title"),
        F.concat(F.lit(C.NVD_DETAIL_URL.split("{")[0]), cid).alias("url"),
        *_registry_cols(name, category, tier),
        F.coalesce(parse_iso(cve["published"]), now_lit(now)).alias("published"),
        desc.alias("description"),
        cvss_metric_pick(cve["metrics"]).alias("cvss_score"),
        F.when(cid != "", F.array(cid)).otherwise(F.array().cast("array<string>")).alias("cve_ids"),
    )
    return _finish(out, None)


# ---------------------------------------------------------------- OSV (SRC3, SRC8, W2)

OSV_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("modified", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("severity", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("score", T.StringType())]))),
    ]
)


def read_osv(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """Extracted per-ecosystem folders ``root/<ecosystem>/<id>.json``.

    With the archives' ``manifest``, only members that the guard (SRC8) lets through are kept.
    """
    df = spark.read.schema(OSV_SCHEMA).option("multiLine", "true").json(f"{root}/*/*.json")
    path = F.col("_metadata.file_path")
    out = df.select(
        F.monotonically_increasing_id().alias("seq"),
        F.struct(*[F.col(c) for c in OSV_SCHEMA.fieldNames()]).alias("r"),
        F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("ecosystem"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("filename"),
    )
    if manifest is None:
        return out
    safe = archive_manifest_guard(manifest).select("ecosystem", F.regexp_extract("filename", r"([^/]+)$", 1).alias("filename"))
    return out.join(safe, ["ecosystem", "filename"], "left_semi")


def read_osv_archives(spark: SparkSession, root: str, **limits: int) -> DataFrame:
    """Zip archives ``root/<ecosystem>.zip`` or ``root/<ecosystem>/<any>.zip``, through the guard (SRC8).

    Members that hold no JSON object give no row.
    """
    members = read_archives(spark, root, **limits)
    whole = F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT")
    return members.where(whole).select(
        F.monotonically_increasing_id().alias("seq"), F.from_json("text", OSV_SCHEMA).alias("r"), "ecosystem", "filename"
    )


def cvss_vector_score(severity: Column) -> Column:
    """First CVSS_V3/CVSS_V4 entry's 'BS:<n>' value; later entries are not tried."""
    first = F.try_element_at(F.filter(F.coalesce(severity, F.array()), lambda s: s["type"].isin("CVSS_V3", "CVSS_V4")), F.lit(1))
    bs = F.regexp_extract(F.coalesce(first["score"], F.lit("")), r"BS:([\d.]+)", 1)
    return F.when(bs != "", bs.try_cast("double"))


def cve_aliases(aliases: Column) -> Column:
    """Aliases that start with 'CVE-' (case-sensitive)."""
    return F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.startswith("CVE-"))


def osv_items(records: DataFrame, name: str, category: str, tier: int, cutoff, per_ecosystem: int = C.OSV_MAX_PER_ECOSYSTEM) -> DataFrame:
    """``records``: seq, r (struct per OSV_SCHEMA), ecosystem, filename.

    Date = modified, else published (when ``modified`` is absent); an
    unparsable date drops the record. After the cutoff, the first
    ``per_ecosystem`` records by file name (descending) are kept (W2).
    """
    r = F.col("r")
    date_str = F.when(r["modified"].isNotNull(), r["modified"]).otherwise(F.coalesce(r["published"], F.lit("")))
    vid = F.coalesce(r["id"], F.lit(""))
    summary = F.coalesce(r["summary"], F.lit(""))
    out = records.select(
        "seq",
        "ecosystem",
        "filename",
        F.when(summary != "", F.concat(vid, F.lit(": "), summary)).otherwise(vid).alias("title"),
        F.concat(F.lit(C.OSV_DETAIL_URL.split("{")[0]), vid).alias("url"),
        *_registry_cols(name, category, tier),
        parse_iso(date_str).alias("published"),
        F.substring(F.coalesce(r["details"], F.lit("")), 1, C.DESCRIPTION_MAX).alias("description"),
        cvss_vector_score(r["severity"]).alias("cvss_score"),
        cve_aliases(r["aliases"]).alias("cve_ids"),
    ).where(F.col("published").isNotNull())
    if cutoff is not None:
        out = out.where(F.col("published") >= now_lit(cutoff))
    from ..operators.report import top_per_group

    out = top_per_group(out, "ecosystem", [F.desc("filename")], per_ecosystem, "_rn")
    return _finish(out, None)


def archive_manifest_guard(
    manifest: DataFrame, member_max: int = C.OSV_MAX_MEMBER_BYTES, total_max: int = C.OSV_MAX_TOTAL_BYTES
) -> DataFrame:
    """SRC8: safe ``.json`` members of each ecosystem archive.

    Drops absolute paths and '..' segments (after '\\' → '/'), members over
    ``member_max`` bytes, and every member of an archive whose *unfiltered*
    total exceeds ``total_max``. ``manifest``: ecosystem, filename, file_size.
    The total is a grouped sum joined back (no window over the group).
    """
    totals = manifest.groupBy("ecosystem").agg(F.sum("file_size").alias("_total"))
    parts = F.split(F.regexp_replace("filename", r"\\", "/"), "/")
    safe = (
        ~F.col("filename").startswith("/")
        & ~F.array_contains(parts, "..")
        & (F.col("file_size") <= F.lit(member_max))
        & F.col("filename").endswith(".json")
    )
    return manifest.join(totals.where(F.col("_total") <= F.lit(total_max)), "ecosystem", "left_semi").where(safe)


# ---------------------------------------------------------------- KEV (SRC4)

KEV_VULN_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["cveID", "vendorProject", "product", "vulnerabilityName", "shortDescription", "dateAdded", "dueDate"]]
)
KEV_FILE_SCHEMA = T.StructType([T.StructField("vulnerabilities", T.ArrayType(KEV_VULN_SCHEMA))])


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(KEV_FILE_SCHEMA).option("multiLine", "true").json(path)
    return df.select(F.explode("vulnerabilities").alias("k")).select(F.monotonically_increasing_id().alias("seq"), "k")


def kev_description(due: Column, desc: Column) -> Column:
    """The fixed explanation sentences, with the due date when given."""
    tail = F.concat(F.lit("Actively exploited in the wild. Patch is available. "), desc)
    return F.when(F.coalesce(due, F.lit("")) != "", F.concat(F.lit("Patch required by "), due, F.lit(". "), tail)).otherwise(tail)


def kev_items(rows: DataFrame, name: str, category: str, tier: int, cutoff, now) -> DataFrame:
    """``rows``: seq, k (struct per KEV_VULN_SCHEMA)."""
    k = F.col("k")
    cid = F.coalesce(k["cveID"], F.lit(""))
    desc = F.substring(F.coalesce(k["shortDescription"], F.lit("")), 1, C.DESCRIPTION_MAX)
    out = rows.select(
        "seq",
        F.concat(
            F.lit("[CISA KEV] "), cid, F.lit(" — "), F.coalesce(k["vendorProject"], F.lit("")), F.lit(" "),
            F.coalesce(k["product"], F.lit("")), F.lit(": "), F.coalesce(k["vulnerabilityName"], F.lit("")),
        ).alias("title"),
        F.lit(C.KEV_URL).alias("url"),
        *_registry_cols(name, category, tier),
        F.coalesce(parse_day(k["dateAdded"]), now_lit(now)).alias("published"),
        kev_description(k["dueDate"], desc).alias("description"),
        F.lit(C.KEV_CVSS).alias("cvss_score"),
        F.when(cid != "", F.array(cid)).otherwise(F.array().cast("array<string>")).alias("cve_ids"),
        cid.alias("cve_id"),
    )
    if cutoff is not None:
        out = out.where(F.col("published") >= now_lit(cutoff))
    return _finish(FL.legacy_cve(out, "cve_id"), None)


# ---------------------------------------------------------------- news aggregator (SRC5, F4, W5)

HN_ITEM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("descendants", T.IntegerType()),
    ]
)


def read_hn(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed ``path/ids`` (files of one JSON list, best first) and ``path/items`` (one story object per line).

    Returns (ranked ids, items) for ``hn_items``.
    """
    lists = spark.read.option("wholetext", "true").text(f"{path}/ids")
    ranked = lists.select(F.posexplode(F.from_json("value", "array<bigint>")).alias("rank", "id"))
    return ranked, spark.read.schema(HN_ITEM_SCHEMA).json(f"{path}/items")


def hn_items(ranked_ids: DataFrame, items: DataFrame, name: str, category: str, tier: int, cutoff) -> DataFrame:
    """``ranked_ids``: (rank, id) of the top-stories list; ``items``: HN_ITEM_SCHEMA rows.

    Scans the first 200 ids, keeps security-related stories inside the
    look-back window, and returns at most 30 in list order. The 30-row
    limit is the feature (a top list), applied after the filters.
    """
    top = ranked_ids.where(F.col("rank") < C.HN_TOP_STORIES)
    j = top.join(items, "id")
    title = X.py_strip(F.coalesce(F.col("title"), F.lit("")))
    pts = F.coalesce(F.col("score"), F.lit(0))
    rows = j.where(F.col("type") == "story").select(
        "rank",
        F.col("id").alias("seq"),
        title.alias("title"),
        F.coalesce(X.safe_url(F.coalesce(F.col("url"), F.lit(""))), F.concat(F.lit(C.HN_ITEM_URL.split("{")[0]), F.col("id").cast("string"))).alias("url"),
        *_registry_cols(name, category, tier),
        F.timestamp_seconds(F.coalesce(F.col("time"), F.lit(0))).alias("published"),
        F.format_string("HackerNews | %s points | %s comments", pts, F.coalesce(F.col("descendants"), F.lit(0))).alias("description"),
        pts.alias("hn_points"),
        F.array().cast("array<string>").alias("cve_ids"),
    )
    rows = FL.security_related(rows.where(F.length("title") > 0))
    if cutoff is not None:
        rows = rows.where(F.col("published") >= now_lit(cutoff))
    rows = rows.orderBy("rank").limit(C.HN_MAX_ITEMS)
    return _finish(rows, None)


# ---------------------------------------------------------------- generic JSON feed (SRC6, W3)


def _first_text(v: Column, keys: list[str]) -> Column:
    """First truthy string among ``keys`` (Python ``a or b or c``)."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys], F.lit(""))


def json_feed_items(docs: DataFrame, name: str, category: str, tier: int, cutoff, now) -> DataFrame:
    """``docs``: feed_id, text (one JSON document per feed).

    The document is a list, or an object whose first present key among
    items/data/entries/results/vulnerabilities holds the list; the first 50
    raw entries are read before any filter (W3).
    """
    v = F.try_parse_json("text")
    d = docs.select("feed_id", v.alias("v"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    container = None
    for k in C.JSON_FEED_CONTAINER_KEYS:
        got = F.try_variant_get("v", f"$.{k}", "variant")
        present = F.array_contains(F.coalesce(F.json_object_keys(F.to_json("v")), F.array().cast("array<string>")), k)
        container = F.when(present, got) if container is None else container.when(present, got)
    arr = F.when(is_list, F.col("v")).otherwise(container)
    d = d.select("feed_id", F.try_variant_get(arr, "$", "array<variant>").alias("entries"))
    e = d.select("feed_id", F.posexplode("entries").alias("pos", "e")).where(F.col("pos") < C.JSON_FEED_MAX_RAW)
    desc_src = F.when(
        F.array_contains(F.coalesce(F.json_object_keys(F.to_json("e")), F.array().cast("array<string>")), "description"),
        F.coalesce(F.try_variant_get("e", "$.description", "string"), F.lit("")),
    ).otherwise(F.coalesce(F.try_variant_get("e", "$.body", "string"), F.lit("")))
    date_s = _first_text(F.col("e"), ["published_at", "updated_at", "created_at"])
    out = e.select(
        (F.col("feed_id") * F.lit(1000) + F.col("pos")).alias("seq"),
        X.py_strip(_first_text(F.col("e"), ["title", "name", "summary"])).alias("title"),
        X.safe_url(X.py_strip(_first_text(F.col("e"), ["url", "link", "html_url"]))).alias("url"),
        *_registry_cols(name, category, tier),
        F.coalesce(parse_iso(date_s), now_lit(now)).alias("published"),
        F.substring(X.strip_html(desc_src), 1, C.DESCRIPTION_MAX).alias("description"),
    ).withColumn("cve_ids", X.extract_cves(F.concat_ws(" ", "title", "description")))
    return _finish(FL.required_fields(out), cutoff)


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("wholetext", "true").text(path)
    return df.select(F.monotonically_increasing_id().alias("feed_id"), F.col("value").alias("text"))


# ---------------------------------------------------------------- registry (SRC7, J5)

REGISTRY_SCHEMA = "category STRING, name STRING, type STRING, url STRING, tier INT, enabled BOOLEAN"


def registry_parser(type_col: Column, url_col: Column) -> Column:
    """Which record parser a registry row selects (NULL = unknown type)."""
    return (
        F.when(type_col == "rss", F.lit("rss"))
        .when(type_col == "nvd_api", F.lit("nvd"))
        .when(type_col == "osv_api", F.lit("osv"))
        .when(type_col == "hn_api", F.lit("hn"))
        .when((type_col == "json_api") & F.lower(url_col).contains("cisa"), F.lit("kev"))
        .when(type_col == "json_api", F.lit("json_feed"))
    )


def active_registry(registry: DataFrame) -> DataFrame:
    """SRC7: enabled rows (missing = enabled) with a known parser; tier defaults to 3."""
    enabled = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in registry.columns else F.lit(True)
    return registry.where(enabled).select(
        "category",
        "name",
        "type",
        "url",
        F.coalesce(F.col("tier"), F.lit(C.DEFAULT_TIER)).alias("tier"),
        registry_parser(F.col("type"), F.col("url")).alias("parser"),
    ).where(F.col("parser").isNotNull())


def attach_registry(records: DataFrame, registry: DataFrame, key: str = "source_name") -> DataFrame:
    """Attach category/tier to records by source name (inner join).

    The registry is small by nature (one row per configured feed); it is
    broadcast only after a count proves it.
    """
    from ..operators.report import checked_broadcast

    reg = active_registry(registry).select(
        F.col("name").alias(key), F.col("category").alias("source_category"), F.col("tier").alias("source_tier"), "parser"
    )
    return records.join(checked_broadcast(reg), key)
