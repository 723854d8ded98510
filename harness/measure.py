"""Markdown table of timings and plan facts: ``python -m harness.measure``.

Each query is checked against its SQL at the smaller scale first, which also warms it up;
then one run per scale is timed into the noop sink, publishing its inputs included. Plan
facts are those of the last plan, before adaptive execution simplifies it.
"""

from __future__ import annotations

import re
import time

from harness.compare import compare_one, database
from harness.oracle import oracle
from harness.queries import QUERIES
from tillhouse.session import local_session

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def once(spark, name: str, directory: str) -> tuple[float, str]:
    started = time.perf_counter()
    df = QUERIES[name](spark, directory)
    df.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - started
    return seconds, df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    spark, con, sqls = local_session(8), database(SMALL), oracle()
    print("| Key | SQL agrees | sf0.01 s | sf0.1 s | growth | exchanges | broadcasts |")
    print("|---|---|---|---|---|---|---|")
    for name in QUERIES:
        problem = compare_one(spark, con, SMALL, name, sqls.get(name))
        small, _ = once(spark, name, SMALL)
        large, plan = once(spark, name, LARGE)
        shuffles = len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|Single)", plan))
        broadcasts = len(re.findall(r"(?<!Reused)BroadcastExchange", plan))
        print(
            f"| `{name}` | {'yes' if problem is None else 'NO: ' + problem} | {small:.2f} "
            f"| {large:.2f} | ×{large / small:.1f} | {shuffles} | {broadcasts} |",
            flush=True,
        )


if __name__ == "__main__":
    main()
