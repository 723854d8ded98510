"""The nine retail source tables, derived from a TPC-H-like parquet directory.

The derivation makes the data dirty on purpose: padded and mixed-case text, emails shared
by two customers, negative prices, codes missing from lookups, refunds that must be
refused. Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Valid on Spark and on the SQL engine that checks it; {name} stands for an input table.
VIEWS = {
    "country_ref": """
        SELECT 'N' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS country_code,
               n_name AS country_name
        FROM {nation} WHERE n_nationkey <> 24""",
    "status_ref": """
        SELECT * FROM (VALUES ('F', 'Completed'), ('O', 'pending'), ('P', 'cancelled'))
                 AS t(status_code, status_name)""",
    "category_ref": """
        SELECT DISTINCT p_type AS category_code, lower(p_type) AS category_name
        FROM {part} WHERE p_type <> 'PROMO'""",
    "stores": """
        SELECT CAST(s_suppkey AS INT) AS store_id, ' ' || s_name || ' ' AS store_name,
               ' City ' || CAST(s_suppkey % 10 AS STRING) AS city,
               'n' || lpad(CAST(s_nationkey AS STRING), 2, '0') AS country_code
        FROM {supplier}""",
    "customers": """
        SELECT CAST(c_custkey AS INT) AS customer_id, '  ' || c_name AS full_name,
               CASE WHEN c_custkey % 10 = 9 THEN 'USER' || CAST(c_custkey - 1 AS STRING)
                    ELSE 'user' || CAST(c_custkey AS STRING) END || '@Example.com' AS email,
               'n' || lpad(CAST(c_nationkey AS STRING), 2, '0') AS country_code,
               DATE '1994-01-01' + CAST(c_custkey % 365 AS INT) AS signup_date
        FROM {customer}""",
    "products": """
        SELECT CAST(p_partkey AS INT) AS product_id,
               CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_name || ' ' ELSE p_name END
                   AS product_name,
               CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END AS category_code,
               CAST(CASE WHEN p_partkey % 50 = 49 THEN -1.0 ELSE p_retailprice END
                    AS DECIMAL(10,2)) AS unit_price
        FROM {part}""",
    "transactions": """
        SELECT CAST(o_orderkey AS INT) AS transaction_id,
               CAST(o_orderkey % (SELECT count(*) FROM {supplier}) AS INT) AS store_id,
               CAST(o_custkey AS INT) AS customer_id,
               CAST(o_orderdate AS DATE) AS transaction_date,
               o_orderstatus AS status_code, o_orderpriority AS payment_method
        FROM {orders}""",
    "transaction_items": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS item_id,
               CAST(l_orderkey AS INT) AS transaction_id, CAST(l_partkey AS INT) AS product_id,
               CAST(l_quantity AS INT) AS quantity,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price
        FROM {lineitem}""",
    "refunds": """
        SELECT CAST((l_orderkey * 10 + l_linenumber) * 2 AS INT) AS refund_id,
               CAST(l_orderkey * 10 + l_linenumber AS INT) AS item_id,
               CAST(l_shipdate AS DATE) AS refund_date, 1 AS quantity,
               CAST(CASE WHEN l_linenumber = 1 THEN -5.0 WHEN l_linenumber = 2 THEN 9999999.0
                         ELSE l_extendedprice END AS DECIMAL(10,2)) AS amount, 'full' AS reason
        FROM {lineitem} WHERE l_returnflag = 'R'
        UNION ALL
        SELECT CAST((l_orderkey * 10 + l_linenumber) * 2 + 1 AS INT),
               CAST(l_orderkey * 10 + l_linenumber AS INT),
               CAST(l_shipdate AS DATE) + 5, 1, CAST(l_extendedprice AS DECIMAL(10,2)), 'second'
        FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber IN (3, 4)""",
}


def base_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def retail_table(spark: SparkSession, directory: str, table: str) -> DataFrame:
    text = VIEWS[table]
    inputs = {
        n: base_table(spark, directory, n) for n in BASE_TABLES if "{" + n + "}" in text
    }
    return spark.sql(text, **inputs)


def user_events(spark: SparkSession, directory: str) -> DataFrame:
    """Change events of a per-user table, from the ``events`` table: one envelope per row."""
    at = F.col("ts").cast("timestamp_ntz")
    seconds = F.hour(at) * 3600 + F.minute(at) * 60
    micros = (
        F.unix_date(at.cast("date")).cast("bigint") * 86_400_000_000
        + seconds.cast("bigint") * 1_000_000
        + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
    )
    row = F.struct(
        F.col("user_id").cast("int").alias("user_id"),
        F.col("event_type").alias("last_type"),
        F.col("value").cast("decimal(10,2)").alias("amount"),
        F.unix_date(at.cast("date")).cast("int").alias("day"),
    )
    # Operation of an event type; any other type is an update.
    op = (
        F.when(F.col("event_type") == "view", "r")
        .when(F.col("event_type") == "signup", "c")
        .when(F.col("event_type") == "error", "d")
        .otherwise("u")
    )
    return (
        base_table(spark, directory, "events")
        .select(op.alias("op"), (micros * 1000).alias("ts_ns"), row.alias("row"))
        .select(
            F.struct(
                F.when(F.col("op") == "d", F.col("row")).alias("before"),
                F.when(F.col("op") != "d", F.col("row")).alias("after"),
                "op",
                "ts_ns",
            ).alias("value")
        )
    )


# Columns of that per-user table.
USERS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("last_type", T.StringType()),
        T.StructField("amount", T.DecimalType(10, 2)),
        T.StructField("day", T.DateType()),
    ]
)
