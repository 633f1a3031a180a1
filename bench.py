"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload  # noqa: E402
from structnet.plans.session import tune  # noqa: E402

HEADLINE = ["radius_pair_count", "annotate_final", "chain_interactions", "atom_contacts", "protein_edges",
            "chain_sequence", "best_match", "graph_json"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = tune(SparkSession.builder.master(f"local[{cpus}]").appName("structnet-bench")
                 .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
                 .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):  # the first one warms up
            start = time.perf_counter()
            workload.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
