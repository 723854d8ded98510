"""Gold: star schema with point-in-time customer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.operators.asof import as_of_version
from tillhouse.operators.calendar import full_calendar
from tillhouse.operators.history import dimension
from tillhouse.plans.run import Run


def dim_customer(run: Run) -> DataFrame:
    """One row per version of each customer."""
    return dimension(run.read("silver", "customer_history")).select(
        "customer_key",
        "customer_id",
        "full_name",
        "email",
        F.col("country_name").alias("country"),
        "signup_date",
        "version",
        "valid_from",
        "valid_to",
        "is_current",
    )


def dim_product(run: Run) -> DataFrame:
    return run.read("silver", "products").select(
        F.col("product_id").alias("product_key"),
        "product_id",
        "product_name",
        F.col("category_name").alias("category"),
        "unit_price",
    )


def dim_store(run: Run) -> DataFrame:
    return run.read("silver", "stores").select(
        F.col("store_id").alias("store_key"),
        "store_id",
        "store_name",
        "city",
        F.col("country_name").alias("country"),
    )


def dim_date(run: Run) -> DataFrame:
    return full_calendar(
        [
            run.read("silver", "sales").select("transaction_date"),
            run.read("silver", "refunds").select("refund_date"),
        ],
        run.run_ts,
    )


def fact_sales(run: Run) -> DataFrame:
    keyed = as_of_version(
        run.read("silver", "sales"),
        run.read("gold", "dim_customer"),
        "customer_id",
        "transaction_date",
    )
    return keyed.select(
        F.col("item_id").alias("item_key"),
        F.col("transaction_date").alias("date_key"),
        "customer_key",
        F.col("product_id").alias("product_key"),
        F.col("store_id").alias("store_key"),
        "transaction_id",
        "quantity",
        "unit_price",
        "line_amount",
    )


def fact_refunds(run: Run) -> DataFrame:
    keyed = as_of_version(
        run.read("silver", "refunds"),
        run.read("gold", "dim_customer"),
        "customer_id",
        "refund_date",
    )
    return keyed.select(
        F.col("refund_id").alias("refund_key"),
        F.col("item_id").alias("item_key"),
        F.col("refund_date").alias("date_key"),
        "customer_key",
        F.col("product_id").alias("product_key"),
        F.col("store_id").alias("store_key"),
        "transaction_id",
        "quantity",
        "amount",
        "reason",
    )
