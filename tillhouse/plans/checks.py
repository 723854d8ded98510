"""Data-quality checks as Spark jobs.

Every check is a frame of (check, metric, value, passed). Counting happens on the
executors; a frame has a handful of rows whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.plans.serving import SERVED, SERVED_LAYER
from tillhouse.schemas import OPTIONAL_TABLES, SOURCES, TOTAL
from tillhouse.sources.lake import Lake

Read = Callable[[str, str], DataFrame]
Counts = Callable[[str, str], int]

# Foreign keys of both facts and the dimension that holds each.
FOREIGN_KEYS = {
    "customer_key": "dim_customer",
    "product_key": "dim_product",
    "store_key": "dim_store",
    "date_key": "dim_date",
}


def _row(df: DataFrame, check: str, metric: str | Column, value: str, passed: Column) -> DataFrame:
    name = F.lit(metric) if isinstance(metric, str) else metric
    return df.select(
        F.lit(check).alias("check"),
        name.alias("metric"),
        F.col(value).cast(TOTAL).alias("value"),
        passed.alias("passed"),
    )


def _rows(df: DataFrame, check: str, metrics: Iterable[tuple[str, str, Column]]) -> DataFrame:
    """One row of sums turned into one row per metric (name, column, passed): computed once."""
    made = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(metric).alias("metric"),
            F.col(value).cast(TOTAL).alias("value"),
            passed.alias("passed"),
        )
        for metric, value, passed in metrics
    ]
    return df.select(F.inline(F.array(*made)))


def _stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def published_counts(lake: Lake) -> Counts:
    """Row counts as they were observed while the newest versions were written."""
    return lambda layer, table: lake.version(layer, table).row_count


def _counted(read: Read, layer: str, table: str, counts: Counts | None) -> DataFrame:
    """The number of rows of a table, ``_n``: known from its publication, or from a scan."""
    if counts is None:
        return read(layer, table).agg(F.count("*").alias("_n"))
    known = counts(layer, table)
    return SparkSession.active().range(1).select(F.lit(known).cast("bigint").alias("_n"))


def table_rows(
    read: Read, layer: str, table: str, optional: bool = False, counts: Counts | None = None
) -> DataFrame:
    """One table must have rows."""
    count = _counted(read, layer, table, counts)
    return _row(count, "table_rows", table, "_n", F.lit(optional) | (F.col("_n") > 0))


def row_counts(
    read: Read, layer: str, tables: Iterable[str] = SOURCES, counts: Counts | None = None
) -> DataFrame:
    """Every source table must have rows, except those that may be empty."""
    return _stack(
        table_rows(read, layer, t, t in OPTIONAL_TABLES, counts) for t in tables
    ).withColumn("check", F.lit("row_counts"))


def grain(fact: DataFrame, key: str = "item_key") -> DataFrame:
    """The fact has rows and its key is unique."""
    counted = fact.agg(F.count("*").alias("_n"), F.count_distinct(key).alias("_d")).withColumn(
        "_twice", F.col("_n") - F.col("_d")
    )
    return _rows(
        counted,
        "grain",
        [
            ("rows", "_n", F.col("_n") > 0),
            (f"duplicate_{key}s", "_twice", F.col("_twice") == 0),
        ],
    )


def _unmatched(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Number of rows whose key the other table lacks. Rows are counted per key first, so
    the anti-join sees each key once and a hot key costs nothing."""
    return (
        many.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .join(one.select(key), key, "left_anti")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    )


def orphans(fact: DataFrame, dimensions: Mapping[str, DataFrame], check: str) -> DataFrame:
    """Rows of a fact that miss their dimension, per foreign key. One pass over the fact
    counts the values of all its keys; a null key misses its dimension."""
    pair = lambda key: (F.lit(key).alias("_key"), F.col(key).cast("string").alias("_value"))
    counted = (
        fact.select(F.inline(F.array(*[F.struct(*pair(key)) for key in dimensions])))
        .groupBy("_key", "_value")
        .agg(F.count("*").alias("_n"))
    )
    known = reduce(DataFrame.unionAll, [dim.select(*pair(key)) for key, dim in dimensions.items()])
    per_key = [
        F.coalesce(F.sum(F.when(F.col("_key") == key, F.col("_n"))), F.lit(0)).alias(key)
        for key in dimensions
    ]
    missing = counted.join(known, ["_key", "_value"], "left_anti").agg(*per_key)
    return _rows(missing, check, [(key, key, F.col(key) == 0) for key in dimensions])


def refunds_of_unknown_items(refunds: DataFrame, sales: DataFrame) -> DataFrame:
    missing = _unmatched(refunds, sales, "item_key")
    return _row(missing, "refund_items", "refunds_of_unknown_items", "_n", F.col("_n") == 0)


def one_current_version(dim_customer: DataFrame) -> DataFrame:
    """No customer has two current versions."""
    extra = (
        dim_customer.filter("is_current")
        .agg(F.count("*").alias("_n"), F.count_distinct("customer_id").alias("_d"))
        .withColumn("_extra", F.col("_n") - F.col("_d"))
    )
    return _row(
        extra,
        "current_version",
        "customers_without_one_current_version",
        "_extra",
        F.col("_extra") == 0,
    )


def revenue(fact: DataFrame, sales: DataFrame) -> DataFrame:
    """Gold carries exactly the revenue of silver. Decimal sums, so the comparison is exact."""

    def summed(df: DataFrame, name: str) -> DataFrame:
        amount = F.coalesce(F.sum("line_amount"), F.lit(0)).cast(TOTAL)
        return df.agg(amount.alias("_sum")).withColumn("_name", F.lit(name))

    sums = summed(fact, "fact_revenue").unionByName(summed(sales, "silver_revenue"))
    equal = F.col("_low") == F.col("_high")
    spread = sums.agg(
        F.min("_sum").alias("_low"),
        F.max("_sum").alias("_high"),
        F.max(F.when(F.col("_name") == "fact_revenue", F.col("_sum"))).alias("_fact"),
        F.max(F.when(F.col("_name") == "silver_revenue", F.col("_sum"))).alias("_silver"),
    )
    return _rows(
        spread, "revenue", [("fact_revenue", "_fact", equal), ("silver_revenue", "_silver", equal)]
    )


def gold(read: Read) -> DataFrame:
    """Everything that must hold for the star schema. Rejected sales are reported only."""
    sales, refunds = read("gold", "fact_sales"), read("gold", "fact_refunds")
    dimensions = {key: read("gold", dim) for key, dim in FOREIGN_KEYS.items()}
    rejected = read("silver", "rejected_sales").agg(F.count("*").alias("_n"))
    return _stack(
        [
            grain(sales),
            orphans(sales, dimensions, "orphan_keys"),
            orphans(refunds, dimensions, "refund_orphan_keys"),
            refunds_of_unknown_items(refunds, sales),
            one_current_version(read("gold", "dim_customer")),
            revenue(sales, read("silver", "sales")),
            _row(rejected, "rejected", "rejected_sales", "_n", F.lit(True)),
        ]
    )


def served_counts(
    read: Read,
    served: Read | None = None,
    tables: Iterable[str] = SERVED,
    counts: Counts | None = None,
    served_rows: Counts | None = None,
) -> DataFrame:
    """A served table has as many rows as its lake table."""
    served = served or read

    def compared(table: str) -> DataFrame:
        layer, _ = SERVED[table]
        in_lake = _counted(read, layer, table, counts).withColumnRenamed("_n", "_lake")
        copy = _counted(served, SERVED_LAYER, table, served_rows or counts).withColumnRenamed("_n", "_served")
        both = in_lake.withColumn("_one", F.lit(1)).join(copy.withColumn("_one", F.lit(1)), "_one")
        equal = F.col("_lake") == F.col("_served")
        return _rows(
            both,
            "served",
            [(f"{table}.lake", "_lake", equal), (f"{table}.served", "_served", equal)],
        )

    return _stack(compared(t) for t in tables)


def ingestion(
    read: Read, mode: str = "snapshot", counts: Counts | None = None
) -> DataFrame | None:
    """Landed tables have rows. In change mode nothing is landed, so there is nothing to
    check and the result is None."""
    return None if mode == "cdc" else row_counts(read, "ingestion", counts=counts)


def evaluate(checks: Mapping[str, Callable[[], DataFrame | None]]) -> dict[str, dict]:
    """Run checks and report ``{"passed": bool, "metadata": dict}`` for each. One that
    cannot run has failed; the others still run."""
    results = {}
    for name, build in checks.items():
        try:
            frame = build()
            if frame is None:
                results[name] = {"passed": True, "metadata": {"skipped": "nothing to check"}}
                continue
            rows = frame.collect()
            results[name] = {
                "passed": all(r.passed for r in rows),
                "metadata": {f"{r.check}.{r.metric}": r.value for r in rows},
            }
        except Exception as error:  # noqa: BLE001
            results[name] = {"passed": False, "metadata": {"error": str(error).split("\n")[0]}}
    return results
