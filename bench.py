"""Benchmark: wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is fully executed with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roomcast.plans.registry import queries  # noqa: E402
from roomcast.session import get_spark  # noqa: E402

HEADLINE = [
    "rssi_clean",
    "robust_scale",
    "scan_stats",
    "ap_signal_stats",
    "knn_predict",
    "knn_cv",
    "knn_grid",
    "soft_vote",
    "macro_prf",
    "position_summary",
    "stratified_folds",
    "describe_exact",
    "coverage_drift",
    "nearest_free",
    "candidate_gate",
    "session_decisions",
    "payload_validate",
    "route_table",
    "fingerprint_knn_room",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="roomcast-bench", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_time_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
