"""Bench: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is built and fully executed into the ``noop`` sink (every row is
produced, nothing is collected to the driver). Building counts too: some
queries materialise an intermediate table (checkpoint) while being built.
One warm-up pass over all queries, then the median of $BENCH_REPEAT runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bias_table",            # flagship: confident pairs -> protein stats -> z-scores
    "compare_scores",        # second flagship: id mapping + evidence scores
    "confident_pairs",
    "id_map",
    "network_best",
    "quartile_cascade",
    "weighted_edges",
    "weighted_edges_cascade",
    "describe_score",
    "histogram_corrected",
    "box_stats",
    "interaction_counts",
    "roc_auc",
    "average_precision",
    "sink_csv",
    "read_links_gz",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE

    from pairnet.session import local_session
    from pairnet.plans.queries import registry

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8),
                          app="pairnet-bench")
    reg = registry()

    def run(name: str) -> float:
        t = time.perf_counter()
        reg[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for n in names:  # warm-up
        run(n)
    times = {}
    for n in names:
        times[n] = round(statistics.median(run(n) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "repeat": repeat,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
