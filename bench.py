"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (comma list or ``all``).
Every query runs to a no-op sink, once to warm up and then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shotweave.session import local_session
from shotweave.workloads import QUERIES

HEADLINE = [
    "fp_encode", "tanimoto_mixed", "knn_topk", "knn_topk_noself", "knn_threshold", "knn_lsh", "kshot_train",
    "kshot_test_near", "kshot_test_balanced", "assay_instructions", "property_instructions", "split_group_greedy",
    "split_group_random", "split_random", "mix_01234", "bipartite_core", "edges_renumber", "pair_max_score",
    "metric_roc_auc", "metric_regression",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        warm = run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
        print(f"{name}: first {warm:.2f} s, then {times[name]:.2f} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
