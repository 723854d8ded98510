"""Marts: gross figures, with refunds beside them on the refund's own date.

Facts are summed by their own keys before they meet a dimension. Partial sums collapse a
hot store, product or customer inside each task, and the joins then handle one row per key.
Transactions may be counted that way too: a transaction has one date, store and customer,
so it is counted under exactly one key.

Marts have no order of their own: a table is a set, and its served copy is range-partitioned and
sorted by the served key, so a sort here would be a shuffle for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.functions import total, units, zero_if_missing
from tillhouse.plans.run import Run
from tillhouse.schemas import TOTAL


def _net(gross: str, refunded: str, name: str):
    return (F.col(gross) - F.col(refunded)).cast(TOTAL).alias(name)


def daily_sales(run: Run) -> DataFrame:
    """Sales and refunds per day and store name. A day with refunds only is kept."""
    names = run.read("gold", "dim_store").select("store_key", "store_name")
    day = ["date_key", "store_name"]
    sold = (
        run.read("gold", "fact_sales")
        .groupBy("date_key", "store_key")
        .agg(
            F.count_distinct("transaction_id").alias("transaction_count"),
            units("quantity").alias("units_sold"),
            total("line_amount").alias("revenue"),
        )
        .join(names, "store_key")
        .groupBy(*day)
        .agg(
            units("transaction_count").alias("transaction_count"),
            units("units_sold").alias("units_sold"),
            total("revenue").alias("revenue"),
        )
    )
    refunded = (
        run.read("gold", "fact_refunds")
        .groupBy("date_key", "store_key")
        .agg(total("amount").alias("refund_amount"))
        .join(names, "store_key")
        .groupBy(*day)
        .agg(total("refund_amount").alias("refund_amount"))
    )
    both = sold.join(refunded, day, "full")
    measures = ["transaction_count", "units_sold", "revenue", "refund_amount"]
    return both.select(*day, *[zero_if_missing(both, m).alias(m) for m in measures]).select(
        "*", _net("revenue", "refund_amount", "net_revenue")
    )


def product_sales(run: Run) -> DataFrame:
    """Sales and refunds per category and product name."""
    names = run.read("gold", "dim_product").select("product_key", "category", "product_name")
    product = ["category", "product_name"]
    sold = (
        run.read("gold", "fact_sales")
        .groupBy("product_key")
        .agg(units("quantity").alias("units_sold"), total("line_amount").alias("revenue"))
        .join(names, "product_key")
        .groupBy(*product)
        .agg(units("units_sold").alias("units_sold"), total("revenue").alias("revenue"))
    )
    refunded = (
        run.read("gold", "fact_refunds")
        .groupBy("product_key")
        .agg(total("amount").alias("refund_amount"))
        .join(names, "product_key")
        .groupBy(*product)
        .agg(total("refund_amount").alias("refund_amount"))
    )
    both = sold.join(refunded, product, "left")
    return both.withColumn("refund_amount", zero_if_missing(both, "refund_amount")).select(
        *product,
        "units_sold",
        "revenue",
        "refund_amount",
        _net("revenue", "refund_amount", "net_revenue"),
    )


def customer_sales(run: Run) -> DataFrame:
    """One row per customer that exists now, over all of its versions."""
    versions = run.read("gold", "dim_customer")
    owner = versions.select("customer_key", "customer_id")
    current = versions.filter("is_current").select(
        "customer_id", "customer_key", "full_name", "country"
    )
    bought = (
        run.read("gold", "fact_sales")
        .groupBy("customer_key")
        .agg(
            F.count_distinct("transaction_id").alias("transaction_count"),
            total("line_amount").alias("total_spent"),
            F.max("date_key").alias("last_sale_date"),
        )
        .join(owner, "customer_key")
        .groupBy("customer_id")
        .agg(
            units("transaction_count").alias("transaction_count"),
            total("total_spent").alias("total_spent"),
            F.max("last_sale_date").alias("last_sale_date"),
        )
    )
    refunded = (
        run.read("gold", "fact_refunds")
        .groupBy("customer_key")
        .agg(total("amount").alias("total_refunded"))
        .join(owner, "customer_key")
        .groupBy("customer_id")
        .agg(total("total_refunded").alias("total_refunded"))
    )
    both = bought.join(current, "customer_id").join(refunded, "customer_id", "left")
    return both.withColumn("total_refunded", zero_if_missing(both, "total_refunded")).select(
        "customer_key",
        "full_name",
        "country",
        "transaction_count",
        "total_spent",
        "last_sale_date",
        "total_refunded",
        _net("total_spent", "total_refunded", "net_spent"),
    )
