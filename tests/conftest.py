import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from feedlens.session import REQUIRED_CONF  # noqa: E402

NOW = dt.datetime(2024, 1, 31, 0, 0, 0)

ITEM_SCHEMA = (
    "seq BIGINT, title STRING, url STRING, source_name STRING, source_category STRING, source_tier INT, "
    "published TIMESTAMP, description STRING, cvss_score DOUBLE, cve_ids ARRAY<STRING>, hn_points INT"
)


@pytest.fixture(scope="session")
def spark():
    b = (
        SparkSession.builder.master("local[*]")
        .appName("feedlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-test-ckpt-"))
    yield s


def make_items(spark, rows):
    """rows: dicts with at least title/url; sensible defaults for the rest."""
    out = []
    for i, r in enumerate(rows):
        out.append(
            (
                r.get("seq", i),
                r["title"],
                r.get("url", f"https://example.com/{i}"),
                r.get("source_name", f"Source-{r.get('tier', 2)}"),
                r.get("category", "blogs"),
                r.get("tier", 2),
                r.get("published", NOW - dt.timedelta(hours=r.get("age", 1))),
                r.get("description", ""),
                r.get("cvss"),
                r.get("cve_ids", []),
                r.get("points", 0),
            )
        )
    return spark.createDataFrame(out, ITEM_SCHEMA)
