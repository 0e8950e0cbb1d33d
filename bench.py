"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Median of BENCH_RUNS runs."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from keyloom.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "heatmap_month", "heatmap_int", "heatmap_hash", "hot_buckets_month", "segments_month", "route_counts_month", "route_counts_int", "composite_list_hash_counts",
    "plan_diff", "rebalance_final_counts", "rollover_final_counts", "bounded_read", "move_dedupe_dest", "uniqueness_violations", "keyset_page", "delta_upsert", "snapshot_drift", "parent_oriented_lookup",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="keyloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        own = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - began)
        times[name] = round(statistics.median(own), 3)
    print(json.dumps({"metric": "headline queries, median of runs, summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
