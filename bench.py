"""Runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line of seconds.

Each query is run to the end with a no-op sink, once to warm up the JVM (on sf0.001 where it is there) and then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitengine.plans.registry import QUERIES  # noqa: E402
from pitengine.session import get_session, release  # noqa: E402

HEADLINE = (
    "pit_prior_summary", "population_waterfall", "hierarchical_fallback", "partial_pooling", "recency_features",
    "comparable_topk_global", "comparable_valuation", "warm_start_counts", "dependency_graph", "snapshot_transitions",
    "alerts_deduped", "dedup_merge", "competition_windows", "pit_windows", "calendar_densify", "hhi_concentration",
    "time_split", "resolve_ladder", "search_layers", "entity_card", "latest_as_of", "quality_checks", "html_to_text", "ols_log_linear",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "bench", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    seconds = {}
    try:
        for name in HEADLINE:
            run = lambda d, q=QUERIES[name]: q(spark, d).write.format("noop").mode("overwrite").save()
            if os.path.isdir(warm):
                run(warm)
            began = time.perf_counter()
            run(folder)
            seconds[name] = round(time.perf_counter() - began, 3)
    finally:
        release(spark)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
