"""Headline queries timed on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from binflow.queries import QUERIES, load
from binflow.session import local_session

HEADLINE = (
    "d01_network_kpis", "d05_reading_metrics_long", "d05_site_utilisation", "d10_site_buckets", "e02_collection_cycles",
    "e06_accumulated_waste", "e07_accepted_readings", "c05_as_of_join", "c07_distance_join", "c09_point_in_polygon",
    "i01_baseline_forecast", "i06_backtest", "d21_overload_hours", "i09_score_greedy_plan", "i12_overload_greedy_plan",
    "s07_whatif_replay", "d24_container_demand", "i26_zone_multipliers", "c16_site_routes", "c11_segment_capacity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "binflow-bench")
    load()
    QUERIES["d15_time_bounds"](spark, sf_dir).collect()
    took = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
