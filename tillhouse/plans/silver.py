"""Silver: clean, translate, deduplicate, and keep what was rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.functions import line_amount, strip
from tillhouse.operators import history
from tillhouse.operators.dedupe import rejects, survivor_map, survivors
from tillhouse.operators.lookup import join_lookup, translate
from tillhouse.operators.running import running_total
from tillhouse.plans.run import Run
from tillhouse.schemas import COMPLETED, TRACKED_CUSTOMER_COLUMNS

EMAIL = ["email"]
PRODUCT_IDENTITY = ["product_name", "category_code"]
REFUND_COLUMNS = ["refund_id", "item_id", "refund_date", "quantity", "amount", "reason"]


def clean_customers(run: Run) -> DataFrame:
    return run.source("customers").withColumns(
        {
            "full_name": strip("full_name"),
            "email": F.lower("email"),
            "country_code": F.upper("country_code"),
        }
    )


def clean_products(run: Run) -> DataFrame:
    """Normalised products with a valid price."""
    return (
        run.source("products")
        .filter(F.col("unit_price") >= 0)
        .withColumns(
            {"product_name": strip("product_name"), "category_code": F.upper("category_code")}
        )
    )


def customers(run: Run) -> DataFrame:
    kept = survivors(
        clean_customers(run), EMAIL, "customer_id", ["full_name", "country_code", "signup_date"]
    )
    named = translate(kept, run.source("country_ref"), "country_code", "country_name")
    return named.select(*TRACKED_CUSTOMER_COLUMNS)


def customer_history(run: Run) -> DataFrame:
    """This run's rows of the one table that cannot be rebuilt: it grows by a part per run."""
    current = run.read("silver", "customers").select(*TRACKED_CUSTOMER_COLUMNS)
    earlier = None
    if run.exists("silver", "customer_history"):
        earlier = run.read("silver", "customer_history")
    return history.new_versions(current, earlier, run.run_ts)


def products(run: Run) -> DataFrame:
    kept = survivors(clean_products(run), PRODUCT_IDENTITY, "product_id", ["unit_price"])
    named = translate(kept, run.source("category_ref"), "category_code", "category_name")
    return named.select(
        "product_id", "product_name", "category_code", "category_name", "unit_price"
    )


def stores(run: Run) -> DataFrame:
    clean = run.source("stores").withColumns(
        {
            "store_name": strip("store_name"),
            "city": strip("city"),
            "country_code": F.upper("country_code"),
        }
    )
    named = translate(clean, run.source("country_ref"), "country_code", "country_name")
    return named.select("store_id", "store_name", "city", "country_code", "country_name")


def customer_survivor_map(run: Run) -> DataFrame:
    return survivor_map(clean_customers(run), EMAIL, "customer_id", "surviving_customer_id")


def product_survivor_map(run: Run) -> DataFrame:
    return survivor_map(
        clean_products(run), PRODUCT_IDENTITY, "product_id", "surviving_product_id"
    )


def transactions_completed(run: Run) -> DataFrame:
    """Transactions with a known status that says completed."""
    completed = (
        run.source("status_ref")
        .select("status_code", F.lower("status_name").alias("status"))
        .filter(F.col("status") == COMPLETED)
    )
    return join_lookup(run.source("transactions"), completed, "status_code", "inner").select(
        "transaction_id",
        "store_id",
        "customer_id",
        "transaction_date",
        "status",
        "payment_method",
    )


def transactions(run: Run) -> DataFrame:
    """Completed transactions of known customers, booked on the surviving customer."""
    return (
        transactions_completed(run)
        .join(customer_survivor_map(run), "customer_id")
        .select(
            "transaction_id",
            "store_id",
            F.col("surviving_customer_id").alias("customer_id"),
            "transaction_date",
            "status",
            "payment_method",
        )
    )


def transactions_of_known_parties(run: Run) -> DataFrame:
    """Transactions whose customer and store are valid.

    Both belong to the transaction, so they are checked before items multiply the rows.
    """
    return (
        run.read("silver", "transactions")
        .join(run.read("silver", "customers").select("customer_id"), "customer_id", "left_semi")
        .join(run.read("silver", "stores").select("store_id"), "store_id", "left_semi")
    )


def items_completed(run: Run) -> DataFrame:
    """Items of completed transactions."""
    return run.source("transaction_items").join(
        run.read("silver", "transactions"), "transaction_id"
    )


def sales(run: Run) -> DataFrame:
    """Completed items with a valid product, customer and store, booked on the surviving
    product at the price that was charged."""
    return (
        run.source("transaction_items")
        .join(transactions_of_known_parties(run), "transaction_id")
        .join(product_survivor_map(run), "product_id")
        .select(
            "item_id",
            "transaction_id",
            "store_id",
            "customer_id",
            F.col("surviving_product_id").alias("product_id"),
            "transaction_date",
            "status",
            "payment_method",
            "quantity",
            "unit_price",
            line_amount(F.col("quantity"), F.col("unit_price")).alias("line_amount"),
        )
    )


def rejected_sales(run: Run) -> DataFrame:
    """Completed items that became no sale.

    Sales leave first, on the key the items are already partitioned by; only the rest is
    shuffled to its transactions.
    """
    rest = rejects(run.source("transaction_items"), run.read("silver", "sales"), "item_id")
    return rest.join(
        run.read("silver", "transactions").select("transaction_id", "store_id", "customer_id"),
        "transaction_id",
    ).select(
        "item_id",
        "transaction_id",
        "store_id",
        "customer_id",
        "product_id",
        "quantity",
        "unit_price",
    )


def checked_refunds(run: Run) -> DataFrame:
    """Refunds of known sales with the total refunded on the item so far.

    The total counts every refund of the item, valid or not. Copies of a refund count towards the size of
    its item, so that refunds are deduplicated once.
    """
    refunds = run.source("refunds").select(*REFUND_COLUMNS).filter(F.col("item_id").isNotNull())
    totals = running_total(
        refunds,
        "item_id",
        "refund_date",
        "refund_id",
        "amount",
        "refunded_so_far",
        counted=run.read("bronze", "refunds").select("item_id"),
    )
    sold = run.read("silver", "sales").select(
        "item_id", "transaction_id", "store_id", "customer_id", "product_id", "line_amount"
    )
    return totals.join(sold, "item_id")


def refunds(run: Run) -> DataFrame:
    """Refunds of a positive amount that keep the item's total within its sale."""
    return (
        checked_refunds(run)
        .filter((F.col("amount") > 0) & (F.col("refunded_so_far") <= F.col("line_amount")))
        .select(*REFUND_COLUMNS, "transaction_id", "store_id", "customer_id", "product_id")
    )


def rejected_refunds(run: Run) -> DataFrame:
    return rejects(
        run.source("refunds").select(*REFUND_COLUMNS), run.read("silver", "refunds"), "refund_id"
    )
