"""Headline-query benchmark.

Runs the flagship queries over ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
Each query is forced end to end with the ``noop`` sink (no driver collect);
one untimed warm-up query on sf0.001 runs first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedlens.plans import catalog  # noqa: E402
from feedlens.session import checkpoint_dir, local_session  # noqa: E402

HEADLINE = [
    "relevance_score",
    "extract_incident",
    "exact_dedup",
    "fuzzy_title_pairs",
    "fuzzy_dedup",
    "topic_components",
    "news_digest",
    "incident_report",
    "incident_report_enriched",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="feedlens-bench")
    checkpoint_dir(spark)
    # Untimed warm-up on the smallest fixture so JVM start-up and JIT do not
    # land on whichever query happens to run first.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        catalog.QUERIES["extract_incident"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
