"""One query per operator. Each reads whole tables of a test-data directory."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harness.land import land
from harness.retail import RUNS, Retail
from tillhouse.functions import line_amount
from tillhouse.operators import changes, history
from tillhouse.operators.asof import as_of_version
from tillhouse.operators.calendar import full_calendar
from tillhouse.operators.dedupe import survivors
from tillhouse.operators.lookup import translate
from tillhouse.plans import checks, silver
from tillhouse.plans.pipeline import TABLES, build, load_snapshot
from tillhouse.plans.run import lake_run
from tillhouse.plans.serving import SERVED_LAYER, rank_table, serve, serve_table
from tillhouse.schemas import SOURCES
from tillhouse.session import shared_dir
from tillhouse.sources.lake import Lake
from tillhouse.sources.landing import LANDING, bronze_copy, ingest, parquet_table
from tillhouse.sources.retail_views import USERS, base_table, user_events
from tillhouse.streaming.change_feed import ChangeFeed, landing_glob

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOADED_AT = datetime(2024, 1, 1)
SPLIT_NS = 1_705_276_800_000_000_000  # 2024-01-15 00:00:00 UTC


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def of_retail(name: str, build_frame: Callable[[Retail], DataFrame]) -> None:
    QUERIES[name] = lambda spark, directory: build_frame(Retail(spark, directory))


def new_lake(spark: SparkSession) -> Lake:
    return Lake(spark, shared_dir(spark, "lake"))


# --- Scans, sources, sinks --------------------------------------------------------------
LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
)


@query
def scan_parquet(spark, directory):
    return parquet_table(spark, f"{directory}/lineitem.parquet", LINEITEM)


@query
def lake_roundtrip(spark, directory):
    lake = new_lake(spark)
    lake.publish(Retail(spark, directory).read("bronze", "transactions"), "bronze", "transactions")
    return lake.read("bronze", "transactions")


@query
def lake_overwrite_schema(spark, directory):
    """The second version has other columns; readers get its schema only."""
    lake, transactions = new_lake(spark), Retail(spark, directory).read("bronze", "transactions")
    lake.publish(transactions, "bronze", "transactions")
    lake.publish(
        lake.read("bronze", "transactions").select(
            "transaction_id",
            F.lower("status_code").alias("status"),
            F.year("transaction_date").alias("year"),
        ),
        "bronze",
        "transactions",
    )
    return lake.read("bronze", "transactions")


@query
def ingest_full_refresh(spark, directory):
    lake = new_lake(spark)
    ingest(lake, "orders", base_table(spark, directory, "orders"))
    return lake.read(LANDING, "orders")


@query
def ingest_allow_empty(spark, directory):
    """Rows landed by a full extract, and after an extract that found the table emptied."""
    lake, lines = new_lake(spark), base_table(spark, directory, "lineitem")

    def landed(step: str) -> DataFrame:
        rows = lake.read(LANDING, "lineitem").agg(F.count("*").alias("row_count"))
        return rows.select(F.lit(step).alias("step"), "row_count")

    ingest(lake, "lineitem", lines)
    before = landed("full")
    ingest(lake, "lineitem", lines.filter(F.lit(False)))
    return before.unionByName(landed("emptied"))


@query
def bronze_typed_copy(spark, directory):
    """A landing with widened types and an extra column."""
    landed = (
        Retail(spark, directory)
        .read("ingestion", "transaction_items")
        .select(
            *[F.col(c).cast("bigint") for c in ("item_id", "transaction_id", "product_id")],
            F.col("quantity").cast("bigint"),
            F.col("unit_price").cast("decimal(24,6)"),
            F.lit("extract").alias("_loaded_by"),
        )
    )
    return bronze_copy(landed, "transaction_items", LOADED_AT)


def _served(spark, directory, layer: str, table: str) -> DataFrame:
    retail = Retail(spark, directory)
    retail.stored(layer, table)
    serve_table(retail.lake, table)
    return retail.lake.read(SERVED_LAYER, table)


@query
def serve_publish(spark, directory):
    return _served(spark, directory, "mart", "daily_sales_mart")


@query
def serve_sorted(spark, directory):
    return _served(spark, directory, "gold", "fact_sales")


# --- Silver -----------------------------------------------------------------------------
of_retail("dedupe_by_key", lambda r: r.run.source("transaction_items"))
of_retail("customers_clean", lambda r: silver.clean_customers(r.run))
of_retail("products_clean", lambda r: silver.clean_products(r.run))
of_retail(
    "customer_survivors",
    lambda r: survivors(silver.clean_customers(r.run), ["email"], "customer_id"),
)
of_retail("customer_survivor_map", lambda r: silver.customer_survivor_map(r.run))
of_retail("product_survivor_map", lambda r: silver.product_survivor_map(r.run))
of_retail(
    "translate_lookup",
    lambda r: translate(
        silver.clean_customers(r.run), r.run.source("country_ref"), "country_code", "country_name"
    ).select("customer_id", "country_code", "country_name"),
)
of_retail("transactions_completed", lambda r: silver.transactions_completed(r.run))
of_retail("items_completed", lambda r: silver.items_completed(r.run))
of_retail("sales_semi_valid", lambda r: silver.transactions_of_known_parties(r.run))
of_retail(
    "sales_line_amount",
    lambda r: r.run.source("transaction_items").select(
        "item_id",
        "quantity",
        "unit_price",
        line_amount(F.col("quantity"), F.col("unit_price")).alias("line_amount"),
    ),
)
of_retail(
    "refund_running_total",
    lambda r: silver.checked_refunds(r.run).select(
        "refund_id", "item_id", "refund_date", "amount", "line_amount", "refunded_so_far"
    ),
)
of_retail("silver_customers", lambda r: r.read("silver", "customers"))
of_retail("silver_products", lambda r: r.read("silver", "products"))
of_retail("silver_stores", lambda r: r.read("silver", "stores"))
of_retail("silver_transactions", lambda r: r.read("silver", "transactions"))
of_retail("silver_sales", lambda r: r.read("silver", "sales"))
of_retail("rejected_sales", lambda r: r.read("silver", "rejected_sales"))
of_retail("refunds_valid", lambda r: r.read("silver", "refunds"))
of_retail("rejected_refunds", lambda r: r.read("silver", "rejected_refunds"))

# --- History ----------------------------------------------------------------------------
of_retail("scd2_append", lambda r: r.history(3))
of_retail("scd2_changed", lambda r: history.changed(r.snapshot(2), r.history(1)))
of_retail("scd2_removed", lambda r: history.removed(r.snapshot(2), r.history(1)))
of_retail("scd2_latest", lambda r: history.latest_versions(r.history(3)))
of_retail(
    "scd2_rerun_noop",
    lambda r: history.append_versions(r.snapshot(2), r.history(2), RUNS[2]),
)
of_retail("scd2_dimension", lambda r: r.read("gold", "dim_customer"))
of_retail("dim_customer_current", lambda r: r.read("gold", "dim_customer").filter("is_current"))
of_retail(
    "as_of_version",
    lambda r: as_of_version(
        r.stored("silver", "transactions"),
        r.stored("gold", "dim_customer"),
        "customer_id",
        "transaction_date",
    ).select("transaction_id", "customer_id", "transaction_date", "customer_key"),
)

# --- Gold and marts ---------------------------------------------------------------------
of_retail("dim_product", lambda r: r.read("gold", "dim_product"))
of_retail("dim_store", lambda r: r.read("gold", "dim_store"))
of_retail("dim_date", lambda r: r.read("gold", "dim_date"))
of_retail("fact_sales", lambda r: r.read("gold", "fact_sales"))
of_retail("fact_refunds", lambda r: r.read("gold", "fact_refunds"))
of_retail("mart_daily_sales", lambda r: r.read("mart", "daily_sales_mart"))
of_retail("mart_product_sales", lambda r: r.read("mart", "product_sales_mart"))
of_retail("mart_customer_sales", lambda r: r.read("mart", "customer_sales_mart"))

# --- Change events ----------------------------------------------------------------------
FIRST_LOAD, SECOND_LOAD = datetime(2024, 1, 15), datetime(2024, 2, 15)


def _halves(spark, directory) -> tuple[DataFrame, DataFrame]:
    """Events before and from the split time."""
    events = user_events(spark, directory)
    return (
        events.filter(F.col("value.ts_ns") < SPLIT_NS),
        events.filter(F.col("value.ts_ns") >= SPLIT_NS),
    )


def _feed(spark) -> ChangeFeed:
    return ChangeFeed(new_lake(spark), "users", USERS, "user_id")


def _users(state: DataFrame) -> DataFrame:
    return changes.live(state).select("user_id", "last_type", "amount", "day", "_cdc_ts")


@query
def cdc_latest_event(spark, directory):
    latest = changes.latest_events(user_events(spark, directory), USERS, "user_id")
    return latest.select("_key", "last_type", "amount", "day", "_is_delete", "_cdc_ts")


@query
def cdc_rebuild(spark, directory):
    events = user_events(spark, directory)
    return _users(changes.rebuild_from_events(events, USERS, "user_id", FIRST_LOAD))


@query
def cdc_high_water(spark, directory):
    events = user_events(spark, directory)
    return changes.high_water_mark(
        changes.rebuild_from_events(events, USERS, "user_id", FIRST_LOAD)
    )


@query
def cdc_merge(spark, directory):
    first, second = _halves(spark, directory)
    feed = _feed(spark)
    feed.apply(first, FIRST_LOAD)
    return _users(
        changes.merge_events(feed.state(), second, USERS, "user_id", SECOND_LOAD)
    )


class Landing:
    """A feed over landed files, fed part by part by polls or as a stream."""

    def __init__(self, spark: SparkSession, mode: str):
        self.feed, self.mode, self.root = _feed(spark), mode, shared_dir(spark, "landing")
        self.glob, self.landed = landing_glob(self.root, "users"), 0

    def land(self, events: DataFrame, partition: int = 0) -> None:
        land(events, self.glob.replace("*", str(partition)), self.landed)
        self.landed += 1_000_000

    def apply(self) -> None:
        if self.mode == "poll":
            self.feed.poll(self.glob, FIRST_LOAD)
        else:
            run = self.feed.stream if self.mode == "stream" else self.feed.state_stream
            run(self.glob, f"{self.root}/checkpoint").awaitTermination()

    def add(self, events: DataFrame, partition: int = 0) -> None:
        self.land(events, partition)
        self.apply()

    def users(self) -> DataFrame:
        return _users(self.feed.state())


def _in_halves(spark, directory, mode: str) -> Landing:
    landing = Landing(spark, mode)
    for part in _halves(spark, directory):
        landing.add(part)
    return landing


@query
def cdc_incremental(spark, directory):
    """Three polls: the first builds the table, the second opens only the files that landed
    since, the third finds none."""
    landing = _in_halves(spark, directory, "poll")
    landing.apply()
    return landing.users()


@query
def cdc_after_mark(spark, directory):
    """The newest events after a table's high-water mark, strictly."""
    first, _ = _halves(spark, directory)
    mark = changes.high_water(changes.rebuild_from_events(first, USERS, "user_id", FIRST_LOAD))
    latest = changes.latest_events(user_events(spark, directory), USERS, "user_id", mark)
    return latest.select("_key", "last_type", "amount", "day", "_is_delete", "_cdc_ts")


@query
def cdc_stream_merge(spark, directory):
    """The same landing read as a stream, restarted from its checkpoint."""
    return _in_halves(spark, directory, "stream").users()


@query
def cdc_state_view(spark, directory):
    """The newest row of each key as streaming state, restarted from its checkpoint."""
    return _in_halves(spark, directory, "state").users()


@query
def cdc_reapply_noop(spark, directory):
    """Each half is delivered twice."""
    first, second = _halves(spark, directory)
    feed = _feed(spark)
    for part in (first, first, second, second):
        feed.apply(part, FIRST_LOAD)
    return _users(feed.state())


@query
def cdc_late_event(spark, directory):
    """The older half arrives after the newer one: deletes must hold, old values must not
    come back."""
    first, second = _halves(spark, directory)
    feed = _feed(spark)
    feed.apply(second, FIRST_LOAD)
    feed.apply(first, SECOND_LOAD)
    return _users(feed.state())


@query
def cdc_mode_switch(spark, directory):
    """A full refresh replaces the table between two runs of the stream: the second run
    rebuilds from everything that has landed, not from its own batch."""
    first, second = _halves(spark, directory)
    landing = Landing(spark, "stream")
    landing.add(first)
    snapshot = changes.live(landing.feed.state()).drop("_cdc_ts")
    landing.feed.lake.publish(snapshot, "bronze", "users")
    landing.add(second)
    return landing.users()


def _ties(spark, directory, mode: str) -> DataFrame:
    """After all events, deletes of the even users land with the time of the event that each
    row came from. What landed later counts."""
    events = user_events(spark, directory)
    landing = Landing(spark, mode)
    landing.add(events)
    newest = changes.latest_events(events, USERS, "user_id").filter("_key % 2 = 0")
    row = events.schema["value"].dataType["before"].dataType
    gone = F.struct(
        F.struct(
            F.col("_key").alias("user_id"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in row if f.name != "user_id"],
        ).alias("before"),
        F.lit(None).cast(row).alias("after"),
        F.lit("d").alias("op"),
        F.col("_cdc_ts").alias("ts_ns"),
    )
    landing.add(newest.select(gone.alias("value")), partition=1)
    return landing.users()


@query
def cdc_tie_across_batches(spark, directory):
    return _ties(spark, directory, "stream")


@query
def cdc_tie_across_polls(spark, directory):
    return _ties(spark, directory, "poll")


@query
def cdc_empty_bootstrap(spark, directory):
    """Polling before anything has landed publishes an empty typed table, which later
    events fill."""
    feed = _feed(spark)
    feed.poll(landing_glob(shared_dir(spark, "landing"), "users"), FIRST_LOAD)
    feed.apply(user_events(spark, directory), SECOND_LOAD)
    return _users(feed.state())


# --- Checks -----------------------------------------------------------------------------
def _dimensions(r: Retail) -> dict[str, DataFrame]:
    return {key: r.stored("gold", dim) for key, dim in checks.FOREIGN_KEYS.items()}


def _orphans(r: Retail, fact: str, check: str) -> DataFrame:
    return checks.orphans(r.stored("gold", fact), _dimensions(r), check)


of_retail(
    "check_table_rows", lambda r: checks.table_rows(r.stored, "bronze", "transaction_items")
)


@query
def check_row_counts(spark, directory):
    """Of published source tables, from what was counted while they were written."""
    lake, retail = new_lake(spark), Retail(spark, directory)
    load_snapshot(lake, {t: retail.read("ingestion", t) for t in SOURCES}, LOADED_AT)
    return checks.row_counts(lake.read, "bronze", counts=checks.published_counts(lake))


@query
def check_outcomes(spark, directory):
    """A check that holds, one that does not, one that cannot run and one that is skipped."""
    read = Retail(spark, directory).read
    empty = read("ingestion", "stores").filter(F.lit(False))
    outcomes = checks.evaluate(
        {
            "holds": lambda: checks.table_rows(read, "ingestion", "stores"),
            "fails": lambda: checks.table_rows(lambda *_: empty, "ingestion", "stores"),
            "cannot run": lambda: checks.table_rows(new_lake(spark).read, "ingestion", "stores"),
            "skipped": lambda: checks.ingestion(read, "cdc"),
        }
    )
    rows = [(name, outcome["passed"]) for name, outcome in outcomes.items()]
    return spark.createDataFrame(rows, "name STRING, passed BOOLEAN")


of_retail("check_gold", lambda r: checks.gold(r.stored))
of_retail("check_fact_orphans", lambda r: _orphans(r, "fact_sales", "orphan_keys"))
of_retail("check_refund_orphans", lambda r: _orphans(r, "fact_refunds", "refund_orphan_keys"))
of_retail(
    "check_refund_items",
    lambda r: checks.refunds_of_unknown_items(
        r.stored("gold", "fact_refunds"), r.stored("gold", "fact_sales")
    ),
)
of_retail(
    "check_current_version", lambda r: checks.one_current_version(r.stored("gold", "dim_customer"))
)
of_retail(
    "check_revenue",
    lambda r: checks.revenue(r.stored("gold", "fact_sales"), r.stored("silver", "sales")),
)


def published(spark: SparkSession, directory: str) -> Lake:
    """A lake on which one whole run has been published, with the three-snapshot history."""
    lake, retail = new_lake(spark), Retail(spark, directory)
    load_snapshot(lake, {t: retail.read("ingestion", t) for t in SOURCES}, RUNS[2])
    build(lake, RUNS[2], [("silver", "customers")])
    lake.publish(retail.history(3), "silver", "customer_history")
    rest = [(t.layer, t.name) for t in TABLES if t.name not in ("customers", "customer_history")]
    build(lake, RUNS[2], rest)
    return lake


@query
def lake_table_counts(spark, directory):
    """Rows of every derived table after a whole published run, as counted while it was written."""
    lake = published(spark, directory)
    rows = [(f"{t.layer}.{t.name}", lake.version(*t.place).row_count) for t in TABLES]
    return spark.createDataFrame(rows, "table_name STRING, row_count BIGINT")


@query
def check_served(spark, directory):
    lake = published(spark, directory)
    serve(lake)
    return checks.served_counts(lake_run(lake, RUNS[2]).read, counts=checks.published_counts(lake))


@query
def lake_retention(spark, directory):
    """Versions left of a table that was published five times, and their rows."""
    lake, rows = Lake(spark, shared_dir(spark, "lake"), 3), Retail(spark, directory).read("bronze", "transactions")
    for year in range(1996, 2001):
        lake.publish(rows.filter(F.year("transaction_date") <= year), "bronze", "transactions")
    kept = [(n, lake.version("bronze", "transactions", n).row_count) for n in lake.versions("bronze", "transactions")]
    return spark.createDataFrame(kept, "version INT, row_count BIGINT")


@query
def dim_date_without_facts(spark, directory):
    """The calendar when nothing was sold or refunded: the year of the run."""
    nothing = Retail(spark, directory).read("bronze", "refunds").filter(F.lit(False)).select("refund_date")
    return full_calendar([nothing, nothing], RUNS[2])


def _ranked(spark, directory, table: str) -> DataFrame:
    retail = Retail(spark, directory)
    retail.stored("mart", table)
    return rank_table(retail.lake, table)


@query
def mart_product_ranked(spark, directory):
    return _ranked(spark, directory, "product_sales_mart")


@query
def mart_customer_ranked(spark, directory):
    return _ranked(spark, directory, "customer_sales_mart")


# --- Ad-hoc SQL over gold ---------------------------------------------------------------


@query
def adhoc_current_of_returning(spark, directory):
    """Current versions of the customers whose sales are booked on several versions."""
    retail = Retail(spark, directory)
    return spark.sql(
        """
        SELECT customer_key, customer_id, country FROM {dim_customer}
        WHERE is_current AND customer_id IN (
            SELECT d.customer_id FROM {fact_sales} f JOIN {dim_customer} d USING (customer_key)
            GROUP BY d.customer_id HAVING count(DISTINCT customer_key) > 1)""",
        fact_sales=retail.read("gold", "fact_sales"),
        dim_customer=retail.stored("gold", "dim_customer"),
    )


@query
def adhoc_ordered_read(spark, directory):
    """The whole served fact in its order, every row with its place."""
    retail = Retail(spark, directory)
    retail.stored("gold", "fact_sales")
    serve_table(retail.lake, "fact_sales", file_bytes=64 << 10)
    return retail.lake.numbered(SERVED_LAYER, "fact_sales", "place")


of_retail("adhoc_distinct_days", lambda r: r.read("gold", "fact_sales").select("date_key").distinct())


@query
def adhoc_revenue(spark, directory):
    return spark.sql(
        """
        SELECT count(*) AS sales_rows,
               CAST(round(sum(line_amount), 2) AS DECIMAL(38,2)) AS revenue
        FROM {fact_sales}""",
        fact_sales=Retail(spark, directory).read("gold", "fact_sales"),
    )


@query
def adhoc_version_moved(spark, directory):
    """Sales booked on versions that are no longer current, by the version's country."""
    retail = Retail(spark, directory)
    return spark.sql(
        """
        SELECT f.customer_key, count(*) AS sales_rows,
               CAST(sum(f.line_amount) AS DECIMAL(38,2)) AS revenue
        FROM {fact_sales} f
        WHERE f.customer_key IN (SELECT customer_key FROM {dim_customer} WHERE NOT is_current)
          AND f.quantity != 0
        GROUP BY f.customer_key""",
        fact_sales=retail.read("gold", "fact_sales"),
        dim_customer=retail.stored("gold", "dim_customer"),
    )
