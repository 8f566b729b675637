"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from checks.registry import QUERIES
from webloom.session import build_session, name_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "links_per_host",
    "internal_link_set",
    "token_table",
    "external_media",
    "scan_counters",
    "crawl_edges",
    "reachable_all",
    "resume_list",
    "politeness_schedule",
    "url_map",
    "relinked_external",
    "relinked_internal",
    "rewritten_stylesheets",
    "cleaned_pages",
    "page_checks",
    "site_verdict",
    "issue_preview",
    "guarded_rewrite",
    "site_totals",
    "mirrored_pages",
)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_folder(spark, tempfile.mkdtemp(prefix="webloom-bench-"))
    # The first query compiles and loads what all need: time none of that.
    for name in ("internal_link_set", "scan_counters"):
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
