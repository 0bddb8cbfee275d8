"""Read the landed tables and shape them into the item table.

``news_items`` is the one row type every operator works on:

    seq BIGINT, title STRING, url STRING, source_name STRING,
    source_category STRING, source_tier INT, published TIMESTAMP,
    description STRING, cvss_score DOUBLE, cve_ids ARRAY<STRING>,
    hn_points INT

``seq`` is the arrival order (the reference's list position), so every
tie-break is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions.text import PY_WS

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# FIXED VALUES — headline phrases mixed into the driver's invented prose so
# that the rule tables have something to find (14, selected by a text hash).
HEADLINE_PHRASES = [
    "Ransomware group hits Microsoft Exchange servers",
    "Cisco patch available for CVE-2024-20399 authentication bypass",
    "Phishing campaign targets Okta customers",
    "Zero-day RCE in Ivanti gateway actively exploited, no patch available",
    "Data breach at Change Healthcare: 73 million records exposed",
    "Supply chain attack on npm package maintainers",
    "Fortinet warns of CVE-2024-21762 flaw, update available",
    "Apache Log4j deserialization bug still vulnerable",
    "Quarterly market commentary and outlook",
    "DDoS outage disrupts T-Mobile network",
    "SQL injection in WordPress plugin fixed",
    "Lockbit affiliate demands $22 million ransom",
    "Botnet abuses default password on routers",
    "Privilege escalation in Linux kernel CVE-2024-1086",
]

CATEGORY_BY_MOD6 = ["cve", "blogs", "community", "advisories", "threat_intel", "incidents"]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def phrase_array_sql() -> str:
    return "array(" + ", ".join(_sql_str(p) for p in HEADLINE_PHRASES) + ")"


#: An item's title is the text's first sentence or line, whole.
TITLE_PATTERN = "^[^.!?\\n]*"
#: Characters of a text that nearly always hold a whole description.
LEAD_CHARS = 4 * C.DESCRIPTION_MAX
#: Characters that hold one where white space is as rare as in prose.
NEAR_CHARS = C.DESCRIPTION_MAX + C.DESCRIPTION_MAX // 4


def lead(text: Column) -> Column:
    """``collapse_truncate`` of the whole text, collapsing only its first characters where they suffice.

    A collapsed prefix is a prefix of the collapsed text, so one of full length is the answer.
    """
    short = T.collapse_truncate(F.substring(text, 1, LEAD_CHARS))
    return F.when((F.length(short) >= C.DESCRIPTION_MAX) | (F.length(text) <= LEAD_CHARS), short).otherwise(T.collapse_truncate(text))


def with_lead(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``lead`` of a text column, which is asked for only where a nearer prefix doesn't suffice.

    The prefix is a column of its own, so it is collapsed once for the test and the value.
    """
    near = df.withColumn("_near", T.collapse_truncate(F.substring(text, 1, NEAR_CHARS)))
    enough = (F.length("_near") >= C.DESCRIPTION_MAX) | (F.length(text) <= NEAR_CHARS)
    return near.withColumn(name, F.when(enough, F.col("_near")).otherwise(lead(F.col(text)))).drop("_near")


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item table derived from ``documents`` ⨝ ``events`` ⨝ ``pages``.

    Title, description and join keys are computed beside the scan, so whole texts stay there.
    Two equi-joins on computed keys (sort-merge at scale, both sides
    partitioned on the key); row counts of ``events``/``pages`` are scalar
    subqueries evaluated once. Only the needed columns are read.
    """
    documents = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "value"])
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    cats = " ".join(f"WHEN {i} THEN {_sql_str(c)}" for i, c in enumerate(CATEGORY_BY_MOD6))
    n = len(HEADLINE_PHRASES)
    text = F.col("text")
    documents = with_lead(documents, "text", "description").select(
        "doc_id", "source",
        F.expr("ascii(substr(text,1,1)) + 7*ascii(substr(text,3,1)) + 13*ascii(substr(text,5,1)) + length(split_part(substr(text,1,40),' ',1))").alias("h"),
        F.regexp_extract(text, TITLE_PATTERN, 0).alias("first"),
        "description",
        F.expr("CAST(conv(substr(md5(text),1,8), 16, 10) AS BIGINT)").alias("page_key"),
    )
    df = spark.sql(
        f"""
        WITH k AS (SELECT d.*, (SELECT count(*) FROM {{events}}) AS ne, (SELECT count(*) FROM {{pages}}) AS np FROM {{documents}} d)
        SELECT k.doc_id AS seq,
               concat(element_at({phrase_array_sql()}, CAST(1 + k.h % {n} AS INT)), ': ', k.first) AS title,
               p.url AS url,
               k.source AS source_name,
               CASE k.doc_id % 6 {cats} END AS source_category,
               CAST(1 + k.doc_id % 4 AS INT) AS source_tier,
               CAST(e.ts AS TIMESTAMP) AS published,
               k.description AS description,
               CASE WHEN k.doc_id % 3 = 0 THEN NULL ELSE round(e.value / 50, 1) END AS cvss_score,
               CASE WHEN k.doc_id % 2 = 0 THEN CAST(floor(e.value) AS INT) ELSE 0 END AS hn_points
        FROM k JOIN {{events}} e ON e.event_id = (k.doc_id * 37) % k.ne
               JOIN {{pages}} p ON p.page_id = k.page_key % k.np
        """,
        documents=documents,
        events=events,
        pages=pages,
    )
    return df.withColumn("cve_ids", T.extract_cves(F.concat_ws(" ", "title", "description")))


def news_items_sql() -> str:
    """The same item table as DuckDB SQL (used by the oracle queries)."""
    cats = " ".join(f"WHEN {i} THEN {_sql_str(c)}" for i, c in enumerate(CATEGORY_BY_MOD6))
    arr = "[" + ", ".join(_sql_str(p) for p in HEADLINE_PHRASES) + "]"
    n = len(HEADLINE_PHRASES)
    return f"""
    news_items AS (
      WITH d AS (
        SELECT doc_id, source, text,
               (ascii(substr(text,1,1)) + 7*ascii(substr(text,3,1)) + 13*ascii(substr(text,5,1))
                + length(split_part(substr(text,1,40),' ',1))) AS h
        FROM documents),
      k AS (SELECT d.*, (SELECT count(*) FROM events) AS ne, (SELECT count(*) FROM pages) AS np FROM d),
      base AS (
        SELECT k.doc_id AS seq,
               concat(({arr})[1 + k.h % {n}], ': ', regexp_extract(k.text, '{TITLE_PATTERN}', 0)) AS title,
               p.url AS url,
               k.source AS source_name,
               CASE k.doc_id % 6 {cats} END AS source_category,
               CAST(1 + k.doc_id % 4 AS INT) AS source_tier,
               e.ts AS published,
               substr(regexp_replace(k.text, '{PY_WS}+', ' ', 'g'), 1, {C.DESCRIPTION_MAX}) AS description,
               CASE WHEN k.doc_id % 3 = 0 THEN NULL ELSE round(e.value / 50, 1) END AS cvss_score,
               CASE WHEN k.doc_id % 2 = 0 THEN CAST(floor(e.value) AS INT) ELSE 0 END AS hn_points
        FROM k JOIN events e ON e.event_id = (k.doc_id * 37) % k.ne
               JOIN pages p ON p.page_id = ('0x' || substr(md5(k.text),1,8))::BIGINT % k.np)
      SELECT base.*,
             list_sort(list_distinct(list_transform(
               regexp_extract_all(concat_ws(' ', title, description), '(?i)CVE-\\p{{Nd}}{{4}}-\\p{{Nd}}{{4,7}}'),
               lambda x: upper(x)))) AS cve_ids
      FROM base)
    """
