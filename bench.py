"""Time the headline queries and print one JSON line.

Each query is built and run in full (``noop`` sink). ``value`` is the sum of the medians of
``BENCH_RUNS`` timed runs, after one run that is not counted.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from promoscan import build_session
from registry.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "normalize",
    "with_user_segment",
    "aggregate_time_day",
    "aggregate_time_users_week",
    "kpi_summary",
    "user_kpis",
    "prize_probabilities",
    "user_activity",
    "cohort_retention",
    "claim_stats",
    "rfm",
    "rate_stats_global",
    "lapsed_prize_customers",
)


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = [run(QUERIES[name], spark) for _ in range(RUNS + 1)]
        times[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
