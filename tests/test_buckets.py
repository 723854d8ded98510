"""Published tables that are bucketed by the key others join them by."""

import pytest
from conftest import FIRST_RUN, SHOP, built_lake

from tillhouse.plans import silver
from tillhouse.plans.pipeline import TABLES
from tillhouse.plans.run import lake_run
from tillhouse.sources.lake import Lake


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_scans(df):
    """Folders of the tables whose rows an exchange of the plan moves, and those that none does."""
    moved, still = set(), set()

    def walk(node, under):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan(), under)
        under = under or node.nodeName() == "Exchange"
        if node.nodeName().startswith("Scan"):
            for path in node.relation().location().rootPaths().mkString("|").split("|"):
                (moved if under else still).add("/".join(path.split("/")[-4:-2]))
        children = node.children()
        for i in range(children.size()):
            # An exchange above a join moves the join's rows, not the table's.
            walk(children.apply(i), under and children.size() == 1)

    walk(df._jdf.queryExecution().executedPlan(), False)
    return moved, still


def test_joins_by_the_bucketed_key_do_not_shuffle_the_table(spark, tmp_path, no_broadcast):
    lake = built_lake(spark, tmp_path, only=[t.place for t in TABLES if t.layer == "silver"])
    run = lake_run(lake, "2024-04-10 06:30:00")
    for build, tables in (
        (silver.rejected_sales, {"silver/sales", "silver/transactions"}),
        (silver.checked_refunds, {"silver/sales"}),
        (silver.items_completed, {"silver/transactions"}),
    ):
        moved, still = shuffled_scans(build(run))
        assert tables <= still and not tables & moved, build.__name__


def test_another_session_reads_a_bucketed_table_by_its_path(spark, lake):
    rows = spark.range(100).selectExpr("id", "id % 7 AS k", "CAST(id AS DECIMAL(10,2)) AS v", "DATE'2024-02-29' AS d")
    lake.publish(rows, "silver", "t", bucket_by="k")
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("lake_")]:
        spark.sql(f"DROP TABLE {name}")
    read = Lake(spark, lake.root).read("silver", "t")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    assert read.groupBy("k").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_old_versions_leave_the_catalog(spark, lake):
    before = {t.name for t in spark.catalog.listTables()}
    for n in range(4):
        lake.publish(spark.range(n + 1), "silver", "t", bucket_by="id")
    assert len({t.name for t in spark.catalog.listTables()} - before) == 2
    assert lake.read("silver", "t").count() == 4 and len(SHOP["customers"]) == 4


@pytest.mark.parametrize("table", ["transaction_items", "refunds"])
def test_landed_copies_are_deduplicated_without_a_shuffle(spark, tmp_path, table):
    """Several builders deduplicate them: a run shuffles them once, when it writes them."""
    lake = built_lake(spark, tmp_path, only=[])
    source = lake_run(lake, FIRST_RUN).source(table)
    source.collect()
    assert "Exchange" not in source._jdf.queryExecution().executedPlan().toString()
