"""Headline queries on one folder of tables; prints one JSON line.

Every query runs ``BENCH_RUNS`` times (default 2), each time built, planned and executed anew; the
best time counts, so that JVM warm-up is left out. All result rows are produced by a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcelpay.session import configure  # noqa: E402

HEADLINE = (
    "tiered_pay_summary", "net_dispatch_rows", "weight_tier_pay", "penalty_totals", "statement_all", "fleet_summary",
    "export_stats", "daily_payout_trend", "forecast",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    builder = configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from verification.queries import QUERIES

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = round(time.perf_counter() - start, 3)
            seconds[name] = min(taken, seconds.get(name, taken))
    spark.stop()
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
