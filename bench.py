"""Time the headline queries and print one JSON line.

BENCH_SF_DIR     test-data directory (default /root/testdata/sf0.1)
BENCH_CPUS       threads of the local session (default 8)
BENCH_QUERIES    "headline" (default), "all", or names separated by commas
BENCH_RUNS       timed runs per query; the median counts (default 1)

The session is warmed up once with the WARM_UP queries. A timing covers the whole derivation
from the given tables: publishing the inputs the query needs, and computing its full result
into Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from harness.queries import QUERIES  # noqa: E402
from tillhouse.session import local_session  # noqa: E402

HEADLINE = (
    "dedupe_by_key",
    "customer_survivor_map",
    "product_survivor_map",
    "silver_customers",
    "silver_transactions",
    "silver_sales",
    "rejected_sales",
    "refunds_valid",
    "scd2_append",
    "scd2_dimension",
    "as_of_version",
    "fact_sales",
    "fact_refunds",
    "mart_daily_sales",
    "mart_product_sales",
    "mart_customer_sales",
    "cdc_latest_event",
    "cdc_merge",
    "cdc_stream_merge",
    "serve_sorted",
    "check_gold",
    "lake_table_counts",
)
WARM_UP = ("mart_daily_sales", "cdc_merge")


def timed(spark, name: str, directory: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "headline")
    names = {"headline": HEADLINE, "all": tuple(QUERIES)}.get(wanted, wanted.split(","))

    spark = local_session(cpus, partitions=cpus)
    for name in WARM_UP:
        timed(spark, name, directory)
    seconds = {}
    for name in names:
        seconds[name] = round(
            statistics.median(timed(spark, name, directory) for _ in range(runs)), 3
        )
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds" if wanted == "headline" else "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
