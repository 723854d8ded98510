"""Source tables, keys and constants."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -------------------------------------------------------------------
# Source tables: primary key and column types.
SOURCES = {
    "stores": (
        "store_id",
        "store_id INT, store_name STRING, city STRING, country_code STRING",
    ),
    "products": (
        "product_id",
        "product_id INT, product_name STRING, category_code STRING, unit_price DECIMAL(10,2)",
    ),
    "customers": (
        "customer_id",
        "customer_id INT, full_name STRING, email STRING, country_code STRING, signup_date DATE",
    ),
    "transactions": (
        "transaction_id",
        "transaction_id INT, store_id INT, customer_id INT, transaction_date DATE, "
        "status_code STRING, payment_method STRING",
    ),
    "transaction_items": (
        "item_id",
        "item_id INT, transaction_id INT, product_id INT, quantity INT, unit_price DECIMAL(10,2)",
    ),
    "category_ref": ("category_code", "category_code STRING, category_name STRING"),
    "status_ref": ("status_code", "status_code STRING, status_name STRING"),
    "country_ref": ("country_code", "country_code STRING, country_name STRING"),
    "refunds": (
        "refund_id",
        "refund_id INT, item_id INT, refund_date DATE, quantity INT, amount DECIMAL(10,2), "
        "reason STRING",
    ),
}
# The only source table that may have no rows.
OPTIONAL_TABLES = frozenset({"refunds"})
# Label of a code that its lookup table does not know.
UNKNOWN = "Unknown"
# Start of a customer's first version, and end of the current one.
BEGINNING = "1970-01-01 00:00:00"
FOREVER = "2100-01-01 00:00:00"
# customer_key = customer_id * factor + version.
CUSTOMER_KEY_FACTOR = 1_000_000
# Columns whose change opens a new customer version.
TRACKED_CUSTOMER_COLUMNS = (
    "customer_id",
    "full_name",
    "email",
    "country_code",
    "country_name",
    "signup_date",
)
# Status that makes a transaction count.
COMPLETED = "completed"
# --- End of fixed values ------------------------------------------------------------

MONEY = "decimal(10,2)"
LINE = "decimal(18,2)"
TOTAL = "decimal(38,2)"
# Wall-clock times without a zone: a date's midnight does not depend on the session zone.
MOMENT = "timestamp_ntz"


def primary_key(table: str) -> str:
    return SOURCES[table][0]


def source_schema(table: str, wide_keys: bool = False) -> T.StructType:
    """Column types of a source table; ``wide_keys`` makes its ids 64 bit.

    The source declares 32-bit ids. A table with more than two billion rows needs wider
    ones, and nothing after bronze depends on the width.
    """
    schema = T.StructType.fromDDL(SOURCES[table][1])
    if not wide_keys:
        return schema
    return T.StructType(
        [
            T.StructField(f.name, T.LongType() if f.name.endswith("_id") else f.dataType)
            for f in schema
        ]
    )


def event_schema(columns: T.StructType) -> T.StructType:
    """Change event of a table: row before, row after, operation and time.

    A date travels as its count of days since 1970.
    """
    row = T.StructType(
        [
            T.StructField(
                f.name, T.IntegerType() if isinstance(f.dataType, T.DateType) else f.dataType
            )
            for f in columns
        ]
    )
    value = T.StructType(
        [
            T.StructField("before", row),
            T.StructField("after", row),
            T.StructField("op", T.StringType()),
            T.StructField("ts_ns", T.LongType()),
        ]
    )
    return T.StructType([T.StructField("value", value)])
