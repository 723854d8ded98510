"""Queries over the given tables: the contract, known counts, and a sample against SQL.

``python -m harness.compare`` compares all of them.
"""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from harness.compare import compare_one, database
from harness.oracle import oracle
from harness.queries import QUERIES
from harness.retail import Retail

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

SAMPLE = [
    "dedupe_by_key",
    "customers_clean",
    "products_clean",
    "customer_survivor_map",
    "product_survivor_map",
    "silver_transactions",
    "scd2_changed",
    "scd2_removed",
    "scd2_dimension",
    "as_of_version",
    "mart_daily_sales",
    "cdc_merge",
    "cdc_late_event",
]


@pytest.fixture(scope="module")
def sql():
    return database(f"{DATA}/sf0.001"), contract.oracle_sql()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(oracle())
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(QUERIES) >= 64


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, sql, name):
    con, texts = sql
    assert compare_one(spark, con, f"{DATA}/sf0.001", name, texts[name]) is None


def test_known_counts_of_the_sales_path(spark):
    retail = Retail(spark, f"{DATA}/sf0.001")
    assert retail.run.source("transaction_items").count() == 4599
    assert retail.stored("silver", "customers").count() == 135
    assert retail.read("silver", "products").count() == 147
    sales = retail.stored("silver", "sales")
    assert sales.count() == 1492
    assert sales.agg(F.sum("line_amount")).first()[0] == Decimal("2011923844.79")
    assert retail.read("silver", "rejected_sales").count() == 32
    refunds = retail.stored("silver", "refunds")
    assert refunds.count() == 552
    assert refunds.agg(F.sum("amount")).first()[0] == Decimal("29829431.62")
    assert retail.read("silver", "rejected_refunds").count() == 2247 - 552


def test_known_counts_of_the_history(spark):
    retail = Retail(spark, f"{DATA}/sf0.01")
    assert retail.history(1).count() == 1425
    second = retail.history(2)
    assert second.count() == 1759
    assert second.filter("is_deleted").count() == 129
    assert retail.history(3).count() == 1827
    dim = retail.read("gold", "dim_customer")
    row = dim.agg(
        F.count("*").alias("n"), F.count_if("is_current").alias("c"), F.max("version").alias("v")
    ).first()
    assert (row.n, row.c, row.v) == (1698, 1432, 3)
