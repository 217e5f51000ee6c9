"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_RUNS
(timed runs per query after one warm-up; the median counts). Results go to
Spark's no-op sink, so every row and column is produced but nothing is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zephyria.catalog import QUERIES
from zephyria.session import local_session

HEADLINE = (
    "health_risks",
    "clean_met",
    "clean_aqi",
    "merge_daily",
    "engineer_features",
    "daily_mean",
    "interp_both",
    "outlier_blank",
    "roll_30",
    "rainfall_anomaly",
    "make_sequences",
    "join_met_aqi",
    "seasonal_stats",
    "monthly_climatology",
    "annual_trend",
    "flood_crosstab",
    "aqi_heatmap",
    "risk_profile",
    "risk_describe",
    "uhi_hotspots",
    "regression_metrics",
    "classification_metrics",
    "write_table",
    "risk_job",
    "seasonal_job",
    "json_hourly_arrays",
    "stream_daily_mean",
    "kmeans_wards",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "zephyria-bench", **{"spark.sql.shuffle.partitions": cpus})

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
