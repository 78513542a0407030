"""Benchmark: headline queries on local cores, one JSON line. Each result goes to the noop sink; the time is
the median of three runs after one warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from vestigia.plans import catalog
from vestigia.session import local_session

HEADLINE = [
    "risk_overview", "four_digests", "signature_rules", "token_frequencies", "severity_counts", "analyzer_status",
    "severity_rollup", "metadata_date_rules", "timeline", "severity_order", "neighbour_noise", "identical_groups",
    "shared_id_clusters", "known_tool_lookup", "offset_consistency", "objects_after_range", "revision_diff",
    "duplicate_blocks", "correlate_findings", "evidence_digest", "graph_bfs", "value_pair_chi_square",
    "severity_windows", "near_duplicates", "creator_profile", "modal_value", "signature_clusters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(os.environ.get("BENCH_PARTITIONS", "8")))
    times: dict[str, float] = {}
    for name in names:
        samples = []
        for i in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of median seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(os.path.basename(folder.rstrip("/")).replace("sf", "")), "cores": int(cores),
    }))


if __name__ == "__main__":
    main()
