"""Headline queries, end to end, on local[$BENCH_CPUS] over $BENCH_SF_DIR. Prints one JSON line.

Every run writes its intermediate tables anew. Each time is the median of $BENCH_RUNS runs (1) after one warm-up (none for
the streaming backfill), with the full result written to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from spanloom.plans.batch import forget_tables
from spanloom.plans.queries import QUERIES
from spanloom.session import local_session

HEADLINE = (
    "template_distribution",
    "otlp_flatten",
    "agent_steps",
    "gpu_around_calls",
    "correlated_traces",
    "drift_windows",
    "path_mutations",
    "live_correlation",
    "judged_traces",
    "latency_percentiles",
    "network_rates",
    "incident_labels",
    "nearest_vectors",
    "stream_backfill",
)


def timed(spark, name: str, folder: str) -> float:
    forget_tables()
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names or HEADLINE:
        streaming = name == "stream_backfill"
        if not streaming:
            timed(spark, name, folder)
        count = 1 if streaming else runs
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(count)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
