"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from residua.plans.catalog import QUERIES  # noqa: E402
from residua.session import build_session  # noqa: E402

HEADLINE = [
    "kmer_radius_exact", "kmer_radius_lsh", "radius_exact", "radius_lsh", "nearest_center", "lsh_recall",
    "kmer_positions", "kmer_count", "kmer_distinct_stats", "feature_histogram", "klsh_buckets", "kmer_blosum",
    "weight_matrix", "orf_frames", "pvalue_adjust", "centroid", "leader_clusters", "seed_runs", "align_hits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g"),
           "spark.sql.shuffle.partitions": str(4 * int(cpus)), "spark.log.level": "ERROR",
           "spark.ui.showConsoleProgress": "false"},
    )
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        # every column is computed, nothing is collected
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
