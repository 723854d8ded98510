"""The point-in-time join against a plain version."""

import random
from datetime import date, datetime, timedelta

from tillhouse.operators.asof import as_of_version

FOREVER = datetime(2100, 1, 1)
VERSION = "customer_id INT, customer_key BIGINT, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ"


def plain(facts, versions):
    out = []
    for number, who, day in facts:
        for customer, key, start, end in versions:
            if day is not None and customer == who and start <= datetime.combine(day, datetime.min.time()) < end:
                out.append((number, who, day, key))
    return sorted(out)


def test_random_histories_with_gaps_and_exact_midnights(spark):
    rng = random.Random(3)
    versions, facts = [], []
    for who in range(30):
        at = datetime(2020, 1, 1)
        for n in range(rng.randrange(6)):
            start = at + timedelta(hours=rng.choice([0, 24, 31, 300]))
            at = start + timedelta(hours=rng.choice([24, 48, 7, 500]))
            versions.append((who, who * 100 + n, start, FOREVER if n == 5 else at))
    for n in range(900):
        day = None if n % 60 == 0 else date(2019, 12, 28) + timedelta(rng.randrange(90))
        facts.append((n, None if n % 70 == 0 else 4 if n % 3 == 0 else rng.randrange(32), day))
    got = as_of_version(
        spark.createDataFrame(facts, "number INT, customer_id INT, bought DATE").repartition(3),
        spark.createDataFrame(versions, VERSION),
        "customer_id",
        "bought",
    )
    assert got.columns == ["number", "customer_id", "bought", "customer_key"]
    assert sorted(map(tuple, got.collect())) == plain(facts, versions)


def rows_of(plan):
    """Rows that each operator of an executed plan put out."""
    found, queue = [], [plan]
    while queue:
        node = queue.pop()
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append(metric.get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            queue.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            queue.append(node.plan())
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
    return found


def test_many_versions_of_one_customer_do_not_multiply_its_facts(spark):
    versions = spark.range(10_000).selectExpr(
        "1 AS customer_id", "id AS customer_key",
        "CAST(timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ'2000-01-01 00:00:00') AS TIMESTAMP_NTZ) AS valid_from",
        "CAST(timestampadd(HOUR, CAST(id AS INT) + 1, TIMESTAMP_NTZ'2000-01-01 00:00:00') AS TIMESTAMP_NTZ) AS valid_to",
    )
    facts = spark.range(20_000).selectExpr("id", "1 AS customer_id", "date_add(DATE'2000-01-01', CAST(id % 400 AS INT)) AS bought")
    joined = as_of_version(facts, versions, "customer_id", "bought")
    rows = joined.collect()
    assert len(rows) == 20_000
    assert all(r.customer_key == 24 * (r.bought - date(2000, 1, 1)).days for r in rows)
    counts = rows_of(joined._jdf.queryExecution().executedPlan())
    assert max(counts) <= 30_000 and 20_000 in counts
