"""Security-news analytics on Spark: ingest, dedup, score, cluster, report."""
