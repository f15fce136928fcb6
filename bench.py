"""Wall time of the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quarterly_panel", "calendar_lags", "sequence_lags", "leave_one_out", "prior_sales", "target_encoding", "out_of_fold_encoding",
    "segment_metrics", "confidence", "time_holdout", "nearest_flat", "nearest_attributes", "count_arc", "count_by_category", "assign_region",
    "region_rates", "comparables", "rate_asof", "nearest_quarter", "value_city", "value_districts", "area_trend", "sales_tiles", "landed_deals", "listing_pages",
]


def main() -> None:
    from hectare.plans import all_queries
    from hectare.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = all_queries().QUERIES
    # start-up cost of the JVM is not a query's time
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
