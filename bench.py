"""Time the headline queries and print one JSON line.

`BENCH_SF_DIR` (default /root/testdata/sf0.1) and `BENCH_CPUS` (default 8) choose data and cores.
Each query is run once to warm up and then timed over all its rows; `value` is the sum of times.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from swipesight.plans import catalog  # noqa: E402
from swipesight.session import build_session  # noqa: E402

HEADLINE = [
    "fraud_by_vendor_category", "fraud_by_hour", "top_values", "missing_values", "dataset_summary",
    "describe_transactions", "amount_box_by_label", "label_correlations",
    "customer_value", "premium_summary", "limit_summary", "suspicion_summary", "cashback_effect",
    "insurance_potential", "rolling_features", "customer_features", "all_features",
    "interval_counts", "autocorrelation", "arrival_patterns", "speed_segments",
    "customer_links", "connected_components", "degree_centrality", "ranking_metrics", "roc_points",
    "clock_model_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.entries(), {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
