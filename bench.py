"""Benchmark: wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "processed_features",
    "impute_full",
    "rolling_lags",
    "spatial_features",
    "completeness",
    "clean_samples",
    "gap_runs",
    "training_windows",
    "rolling_instances",
    "sample_metrics",
    "vector_metrics",
    "conformal_metrics",
    "param_search",
    "psi",
    "qc_summary",
]


def main() -> None:
    from hourweave.registry import QUERIES, edges, features, filled, readings, stations
    from hourweave.session import local_session

    spark = local_session("bench", CPUS, int(CPUS))

    def run(build) -> float:
        started = time.time()
        build().write.format("noop").mode("overwrite").save()
        return time.time() - started

    # start the JVM and its code paths, then write the shared tables once
    run(lambda: QUERIES["processed_features"](spark, "/root/testdata/sf0.001"))
    started = time.time()
    for table in (readings, stations, edges, features, filled):
        table(spark, SF_DIR)
    tables_sec = time.time() - started

    seconds = {name: round(run(lambda n=name: QUERIES[n](spark, SF_DIR)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "shared_tables_sec": round(tables_sec, 3),
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
