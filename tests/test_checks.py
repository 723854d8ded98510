import pytest

from tillhouse.plans import checks
from tillhouse.plans.run import lake_run


@pytest.fixture
def read(built):
    return lake_run(built, "2026-09-15").read


def replaced(read, **tables):
    """A reader that gives other frames for some tables."""
    return lambda layer, table: tables.get(f"{layer}_{table}", None) or read(layer, table)


def result(build):
    return checks.evaluate({"check": build})["check"]


def test_row_counts_pass(read):
    outcome = result(lambda: checks.row_counts(read, "bronze"))
    assert outcome["passed"] and outcome["metadata"]["row_counts.customers"] == 4


def test_row_counts_fail_on_an_empty_table_unless_it_is_optional(read):
    empty = replaced(read, bronze_stores=read("bronze", "stores").limit(0))
    assert not result(lambda: checks.row_counts(empty, "bronze"))["passed"]
    assert not result(lambda: checks.table_rows(empty, "bronze", "stores"))["passed"]
    allowed = replaced(read, bronze_refunds=read("bronze", "refunds").limit(0))
    assert result(lambda: checks.row_counts(allowed, "bronze"))["passed"]


def test_gold_passes_and_reports_rejections(read):
    outcome = result(lambda: checks.gold(read))
    assert outcome["passed"], outcome
    assert outcome["metadata"]["rejected.rejected_sales"] == 1


@pytest.mark.parametrize(
    "table, change, metric",
    [
        ("gold_fact_sales", lambda df: df.union(df), "grain.duplicate_item_keys"),
        ("gold_dim_store", lambda df: df.filter("store_key = 5"), "orphan_keys.store_key"),
        ("gold_dim_product", lambda df: df.filter("product_key = 22"), "refund_orphan_keys.product_key"),
        ("gold_fact_sales", lambda df: df.filter("item_key <> 4001"), "refund_items.refunds_of_unknown_items"),
        ("gold_dim_customer", lambda df: df.union(df), "current_version.customers_without_one_current_version"),
        ("silver_sales", lambda df: df.filter("item_id <> 4001"), None),
        ("gold_fact_sales", lambda df: df.filter("false"), None),
    ],
)
def test_gold_fails_on_bad_data(read, table, change, metric):
    bad = replaced(read, **{table: change(read(*table.split("_", 1)))})
    outcome = result(lambda: checks.gold(bad))
    assert not outcome["passed"]
    if metric:
        assert outcome["metadata"][metric] > 0


def test_served_counts(read):
    tables = ["dim_store", "fact_sales"]
    same = replaced(
        read,
        marts_dim_store=read("gold", "dim_store"),
        marts_fact_sales=read("gold", "fact_sales"),
    )
    assert result(lambda: checks.served_counts(same, tables=tables))["passed"]
    behind = replaced(
        same, marts_fact_sales=read("gold", "fact_sales").limit(2)
    )
    outcome = result(lambda: checks.served_counts(behind, tables=tables))
    assert not outcome["passed"]
    assert outcome["metadata"]["served.fact_sales.served"] == 2


def test_a_check_that_cannot_run_has_failed_and_the_others_run(read):
    def broken():
        raise LookupError("no such table")

    results = checks.evaluate(
        {"broken": broken, "good": lambda: checks.table_rows(read, "bronze", "stores")}
    )
    assert not results["broken"]["passed"] and "no such table" in results["broken"]["metadata"]["error"]
    assert results["good"]["passed"]


def test_landing_is_not_checked_in_change_mode(read):
    assert result(lambda: checks.ingestion(read, "cdc"))["passed"]
    assert result(lambda: checks.ingestion(read))["passed"]
