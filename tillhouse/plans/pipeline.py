"""All derived tables, and whole runs over a lake."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future
from dataclasses import dataclass, replace
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame

from tillhouse.operators import history
from tillhouse.plans import gold, mart, silver
from tillhouse.plans.run import Run, lake_run, together
from tillhouse.plans.serving import serve
from tillhouse.schemas import SOURCES, source_schema
from tillhouse.sources.lake import Lake
from tillhouse.sources.landing import LANDING, bronze_copy, ingest
from tillhouse.streaming.change_feed import ChangeFeed, landing_glob


@dataclass(frozen=True)
class Table:
    """A derived table and its builder. What it needs is what the builder reads.

    The builder of a table that grows ``by_run`` gives one run's new rows and reads, under its own
    name, what the runs before it left. A table that several others join by one key is bucketed by it.
    """

    layer: str
    name: str
    build: Callable[[Run], DataFrame]
    by_run: bool = False
    bucket_by: str | None = None

    @property
    def place(self) -> tuple[str, str]:
        return self.layer, self.name


SILVER = {
    "customers": silver.customers,
    "products": silver.products,
    "stores": silver.stores,
    "customer_history": silver.customer_history,
    "transactions": silver.transactions,
    "sales": silver.sales,
    "refunds": silver.refunds,
    "rejected_sales": silver.rejected_sales,
    "rejected_refunds": silver.rejected_refunds,
}
GOLD = {
    "dim_date": gold.dim_date,
    "dim_store": gold.dim_store,
    "dim_product": gold.dim_product,
    "dim_customer": gold.dim_customer,
    "fact_sales": gold.fact_sales,
    "fact_refunds": gold.fact_refunds,
}
MARTS = {
    "daily_sales_mart": mart.daily_sales,
    "product_sales_mart": mart.product_sales,
    "customer_sales_mart": mart.customer_sales,
}
# Landed copies that several builders deduplicate: bucketed by their primary key, they are shuffled once.
BRONZE_BUCKETS = {"transaction_items": "item_id", "refunds": "refund_id"}
BUCKETS = {"transactions": "transaction_id", "sales": "item_id", "refunds": "item_id"}
TABLES = tuple(
    Table(layer, name, builder, name == "customer_history", BUCKETS.get(name))
    for layer, builders in (("silver", SILVER), ("gold", GOLD), ("mart", MARTS))
    for name, builder in builders.items()
)


def load_snapshot(
    lake: Lake, extracts: Mapping[str, DataFrame], run_ts: datetime | str, wide_keys: bool = False
) -> None:
    """Land full extracts and copy them to bronze with the source's types."""

    def load(table: str) -> None:
        ingest(lake, table, extracts[table])
        bronze = bronze_copy(lake.read(LANDING, table), table, run_ts, wide_keys)
        lake.publish(bronze, "bronze", table, bucket_by=BRONZE_BUCKETS.get(table))

    together(partial(load, table) for table in extracts)


def load_changes(
    lake: Lake,
    events_root: str,
    run_ts: datetime | None = None,
    tables: Iterable[str] = SOURCES,
    wide_keys: bool = False,
) -> dict[str, str]:
    """Merge landed change events into bronze; says per table what happened."""
    names = list(tables)
    outcomes = together(
        partial(
            ChangeFeed(lake, t, source_schema(t, wide_keys)).poll,
            landing_glob(events_root, t),
            run_ts,
        )
        for t in names
    )
    return dict(zip(names, outcomes, strict=True))


def build(
    lake: Lake, run_ts: datetime | str, only: Iterable[tuple[str, str]] | None = None
) -> None:
    """Build derived tables, all or a chosen subset. All start at once, and a builder that
    reads another table of this build waits until that is published, so plans stay short and a
    restarted run reads what is finished."""
    run = lake_run(lake, run_ts)
    wanted = None if only is None else set(only)
    chosen = [t for t in TABLES if wanted is None or t.place in wanted]
    published = {t.place: Future() for t in chosen}

    def publish(table: Table) -> None:
        earlier = history.before_run(lake, *table.place, run_ts) if table.by_run else None

        def read(layer: str, name: str) -> DataFrame:
            if table.by_run and (layer, name) == table.place:
                return earlier
            if (layer, name) in published:
                published[layer, name].result()
            return run.read(layer, name)

        def exists(layer: str, name: str) -> bool:
            own = table.by_run and (layer, name) == table.place
            return earlier is not None if own else run.exists(layer, name)

        try:
            rows = table.build(replace(run, read=read, exists=exists))
            if table.by_run:
                history.publish_run(lake, rows, *table.place, run_ts)
            else:
                lake.publish(rows, *table.place, bucket_by=table.bucket_by)
        except BaseException as failure:
            published[table.place].set_exception(failure)
            raise
        published[table.place].set_result(None)

    # Every table has a thread of its own, as those that wait hold theirs.
    together((partial(publish, t) for t in chosen), max(1, len(chosen)))


def run_snapshot(
    lake: Lake,
    extracts: Mapping[str, DataFrame],
    run_ts: datetime | str,
    publish: bool = True,
    wide_keys: bool = False,
) -> None:
    """One full run: land, bronze, silver, gold, mart, and the served copies."""
    load_snapshot(lake, extracts, run_ts, wide_keys)
    build(lake, run_ts)
    if publish:
        serve(lake)


def run_changes(
    lake: Lake,
    events_root: str,
    run_ts: datetime,
    publish: bool = True,
    wide_keys: bool = False,
) -> dict[str, str]:
    """One incremental run: merge change events, then rebuild what depends on them."""
    outcome = load_changes(lake, events_root, run_ts, wide_keys=wide_keys)
    build(lake, run_ts)
    if publish:
        serve(lake)
    return outcome
