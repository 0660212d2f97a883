"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Every
query runs to its last row; the result is discarded by Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pricelens.plans.queries import QUERIES
from pricelens.session import local_session

HEADLINE = [
    "normalize_titles",
    "best_offer",
    "anchor_compare",
    "report_messages",
    "full_report",
    "stored_report",
    "dedup_title",
    "new_alerts",
    "option_intersection",
    "sim_storage_variants",
    "variants_or_simple",
    "listing_detail",
    "snapshot_roundtrip",
    "extract_listing",
    "extract_detail",
    "catalog_flatten",
    "job_ram_config",
    "job_sim_config",
    "job_detail_links",
    "job_buttons",
    "asof_snapshots",
    "new_alerts_by_run",
    "stream_new_alerts",
    "stream_snapshots",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pricelens-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
