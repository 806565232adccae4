"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is planned and run to
a no-op sink, so the time covers the whole result without moving it to the driver. One untimed query
warms the JVM first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import all_queries  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "panel_summary",
    "two_level_median",
    "pooled_median",
    "quartiles_exclusive",
    "book_summary",
    "asof_price",
    "weighted_price",
    "weekly_shares",
    "top_n_per_group",
    "trailing_mean_partial",
    "rolling_median",
    "change_events",
    "recent_cuts",
    "matched_panel_index",
    "collection_gaps",
    "merge_upsert",
    "merge_fields",
    "series_quality",
    "guidance_buckets",
    "xbrl_facts",
    "supply_clock",
    "evaluate_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "tidemark-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries.QUERIES["daily_depth"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
