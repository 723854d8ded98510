"""Hot keys: a third of all rows on one key."""

from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillhouse.operators.asof import as_of_version
from tillhouse.operators.dedupe import dedupe_by_key, survivor_map
from tillhouse.operators.lookup import join_lookup, translate
from tillhouse.operators.skew import hottest

ROWS = 60_000


@pytest.fixture
def small_partitions(spark):
    """Thresholds at which this test's data counts as large."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_hot_customer_of_the_point_in_time_join_is_spread(spark, lake, small_partitions):
    facts = spark.range(0, ROWS, 1, 8).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000 + 2).cast("int").alias("customer_id"),
        F.expr("date_add(DATE '2026-01-01', CAST(id % 300 AS INT))").alias("day"),
    )
    versions = spark.range(0, 5002).select(
        F.col("id").cast("int").alias("customer_id"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("n"), F.lit("1970-01-01").alias("a"), F.lit("2026-03-01 08:00").alias("b")),
                F.struct(F.lit(2).alias("n"), F.lit("2026-03-01 08:00").alias("a"), F.lit("2100-01-01").alias("b")),
            )
        ).alias("v"),
    ).select(
        "customer_id",
        (F.col("customer_id") * 10 + F.col("v.n")).alias("customer_key"),
        F.col("v.a").cast("timestamp_ntz").alias("valid_from"),
        F.col("v.b").cast("timestamp_ntz").alias("valid_to"),
    )
    lake.publish(facts, "silver", "sales")
    lake.publish(versions, "gold", "dim_customer")
    joined = as_of_version(
        lake.read("silver", "sales"), lake.read("gold", "dim_customer"), "customer_id", "day"
    )
    plan = final_plan(joined)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Cut into its days, the customer that has a third of the rows spreads over the tasks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = joined.select("customer_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = Counter(r.task for r in placed if r.customer_id == 1)
    assert len(hot) > 4 and max(hot.values()) < ROWS / 12
    change = date(2026, 3, 1)
    got = joined.collect()
    assert len(got) == ROWS
    for r in got:
        assert r.customer_key == r.customer_id * 10 + (1 if r.day <= change else 2)


def test_shared_natural_key_is_spread_and_exact(spark, small_partitions):
    df = spark.range(0, 9000, 1, 4).selectExpr(
        "CAST(id AS INT) AS id", "CASE WHEN id % 3 = 0 THEN 'none' ELSE concat('u', id % 4000) END AS email"
    )
    got = {r.id: r.s for r in survivor_map(df, ["email"], "id", "s", hot_rows=500).collect()}
    least = {}
    rows = df.collect()
    for r in rows:
        least[r.email] = min(r.id, least.get(r.email, r.id))
    assert got == {r.id: least[r.email] for r in rows}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_of_hot_and_missing_codes(spark, small_partitions, how):
    df = spark.range(0, 6000, 1, 4).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'A' WHEN id % 3 = 1 THEN NULL ELSE concat('C', id % 50) END AS code"
    )
    lookup = dedupe_by_key(
        spark.createDataFrame([("A", "alpha"), ("A", "alpha"), ("C2", "two")], "code STRING, name STRING"),
        "code",
    )
    joined = join_lookup(df, lookup, "code", how)
    assert sorted(map(str, joined.collect())) == sorted(map(str, df.join(lookup, "code", how).collect()))
    named = translate(df, lookup, "code", "name")
    assert named.count() == 6000
    assert {r.name for r in named.select("name").distinct().collect()} == {"alpha", "two", "Unknown"}


def test_a_hot_code_of_a_reduced_lookup_is_split_and_rows_are_read_once(spark, lake, small_partitions):
    df = spark.range(0, ROWS, 1, 8).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 5000 END AS code", "uuid() AS v")
    lake.publish(df, "silver", "t")
    lookup = dedupe_by_key(spark.range(0, 5000).selectExpr("id AS code", "CAST(id AS STRING) AS name"), "code")
    named = translate(lake.read("silver", "t"), lookup, "code", "name")
    assert named.filter("name = CAST(code AS STRING)").count() == ROWS
    plan = final_plan(named)
    assert "SortMergeJoin(skew=true)" in plan and plan.count("FileScan") == 1


def test_hot_copies_of_one_row_collapse_before_the_shuffle(spark):
    df = spark.range(0, 30_000, 1, 4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id % 7 AS a", "CAST(id AS DECIMAL(10,2)) AS b"
    )
    one = dedupe_by_key(df, "k")
    assert "partial_min" in final_plan(one)
    rows = {r.k: (r.a, r.b) for r in one.collect()}
    assert len(rows) == 20_001 and rows[0] == (0, Decimal(0))


def test_every_hot_key_is_split_by_its_own_count(spark):
    counts = spark.range(5000).selectExpr("id AS k", "id AS n")
    hot = hottest(counts, ["k"], "n", 10)
    assert hot.count() == 4989
    assert {r.k: r["_slots"] for r in hot.filter("k IN (11, 20, 4995)").collect()} == {11: 2, 20: 2, 4995: 500}


def test_days_are_not_the_limit_of_a_running_total(spark):
    """All refunds of one item on one day, in blocks of eight ids."""
    from tillhouse.operators.running import running_total

    day = date(2026, 1, 1) + timedelta(1)
    df = spark.createDataFrame(
        [(n, 1, day, Decimal(1)) for n in range(300)], "id INT, item INT, day DATE, v DECIMAL(10,2)"
    )
    got = running_total(df, "item", "day", "id", "v", "t", block_bits=3).collect()
    assert {r.id: r.t for r in got} == {n: Decimal(n + 1) for n in range(300)}
