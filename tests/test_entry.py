"""Driver contract: entry() runs; every oracle has a query."""

import __spark_entry__ as E


def test_catalog_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {"news_digest", "incident_report", "incident_report_enriched", "fuzzy_dedup", "exact_dedup"} <= set(q)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"cluster_rank", "item_rank", "title", "score"} <= set(df.columns)
