"""Whole runs on the seed data, and the list of tables."""

from dataclasses import replace
from datetime import datetime
from decimal import Decimal
from functools import partial
from itertools import count

import pytest
from conftest import SEED, built_lake, by, frames
from pyspark.sql import functions as F

from harness.land import land
from tillhouse.plans.pipeline import TABLES, build, run_changes, run_snapshot
from tillhouse.plans.serving import SERVED_LAYER
from tillhouse.schemas import SOURCES, event_schema, source_schema
from tillhouse.sources.lake import Lake
from tillhouse.streaming.change_feed import landing_glob

OFFSETS = count(0, 1000)
SALE = ((54, 1, 31, "2024-02-01", "OK", "CARD"), (67, 54, 41, 1, "100.00"))


def served(lake, table):
    return lake.read(SERVED_LAYER, table)


def facts(lake):
    row = served(lake, "fact_sales").agg(F.count("*"), F.sum("line_amount")).first()
    daily = served(lake, "daily_sales_mart").agg(F.sum("revenue")).first()[0]
    assert daily == row[1]
    return row[0], row[1]


def test_snapshot_runs_end_to_end(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    day = iter(datetime(2024, 5, n) for n in range(1, 20))
    source = dict(SEED)

    def run():
        run_snapshot(lake, frames(spark, source), next(day))

    run()
    assert facts(lake) == (6, Decimal("1656.50"))

    source["transactions"] = [*SEED["transactions"], SALE[0]]
    source["transaction_items"] = [*SEED["transaction_items"], SALE[1]]
    source["customers"] = [(31, "Nora Dahl", "nora@mail.test", "LT", "2023-01-02"), *SEED["customers"][1:]]
    source["refunds"] = [
        (1, 67, "2024-02-02", 1, "60.00", "wet"),
        (2, 67, "2024-02-03", 1, "500.00", "more than it sold for"),
    ]
    run()
    assert facts(lake) == (7, Decimal("1756.50"))
    versions = served(lake, "dim_customer").filter("customer_id = 31").collect()
    assert [r.country for r in versions if r.is_current] == ["Lithuania"] and len(versions) == 2
    old_key = next(r.customer_key for r in versions if not r.is_current)
    moved = spark.sql(
        "SELECT count(*) AS n FROM {fact} WHERE customer_key != {key} AND customer_key IN "
        "(SELECT customer_key FROM {dim} WHERE customer_id = 31)",
        fact=served(lake, "fact_sales"), dim=served(lake, "dim_customer"), key=old_key,
    ).first().n
    assert moved == 0
    assert served(lake, "fact_refunds").agg(F.sum("amount")).first()[0] == Decimal("60.00")
    for table, net in (("daily_sales_mart", "net_revenue"), ("customer_sales_mart", "net_spent")):
        assert served(lake, table).agg(F.sum(net)).first()[0] == Decimal("1696.50")
    assert served(lake, "dim_date").count() == 366

    # An emptied lookup labels the customers Unknown and loses no sale.
    source["country_ref"] = []
    run()
    countries = served(lake, "dim_customer").filter("is_current").select("country").distinct()
    assert [r.country for r in countries.collect()] == ["Unknown"]
    assert facts(lake) == (7, Decimal("1756.50"))


BIG = 5_000_000_000


def widened(rows, schema):
    """Rows with every id beyond 32 bits."""
    ids = [n for n, f in enumerate(schema) if f.name.endswith("_id")]
    return [tuple(v + BIG if n in ids and v is not None else v for n, v in enumerate(row)) for row in rows]


@pytest.mark.parametrize("route", ["snapshot", "changes"])
def test_ids_beyond_32_bits_on_both_routes(spark, tmp_path, route, monkeypatch):
    lake, root = Lake(spark, str(tmp_path / "lake")), str(tmp_path / "events")
    wide = {t: widened(rows, source_schema(t)) for t, rows in SEED.items()}
    wide_schema = partial(source_schema, wide_keys=True)
    monkeypatch.setattr("conftest.source_schema", wide_schema)
    monkeypatch.setattr("test_runs.source_schema", wide_schema)
    if route == "snapshot":
        run_snapshot(lake, frames(spark, wide), datetime(2024, 5, 1), wide_keys=True)
    else:
        land_rows(spark, root, 1, **{t: rows for t, rows in wide.items() if rows})
        run_changes(lake, root, datetime(2024, 5, 1), wide_keys=True)
    assert facts(lake) == (6, Decimal("1656.50"))
    keys = [r.item_key for r in served(lake, "fact_sales").collect()]
    assert sorted(keys) == [BIG + i for i, *_ in SEED["transaction_items"]]


def land_rows(spark, root, ts, op="r", **rows):
    """Write events of source rows; each keeps its place in time."""
    for table, data in rows.items():
        schema = source_schema(table)
        df = frames(spark, {table: data})[table]
        days = [
            F.unix_date(f.name).alias(f.name) if f.dataType.typeName() == "date" else F.col(f.name)
            for f in schema
        ]
        row = F.struct(*days)
        nothing = F.lit(None).cast(event_schema(schema)["value"].dataType["after"].dataType)
        value = F.struct(
            (row if op == "d" else nothing).alias("before"),
            (nothing if op == "d" else row).alias("after"),
            F.lit(op).alias("op"),
            F.lit(ts).cast("bigint").alias("ts_ns"),
        )
        folder = landing_glob(root, table).replace("*", "0")
        land(df.select(value.alias("value")), folder, next(OFFSETS))


def test_change_runs_end_to_end(spark, tmp_path):
    lake, root = Lake(spark, str(tmp_path / "lake")), str(tmp_path / "events")
    land_rows(spark, root, 1, **{t: rows for t, rows in SEED.items() if rows})
    land_rows(spark, root, 1, category_ref=[("CDC", "passing")])
    outcome = run_changes(lake, root, datetime(2024, 5, 1))
    assert outcome == {t: "no events" if t == "refunds" else "rebuilt" for t in SOURCES}
    assert facts(lake) == (6, Decimal("1656.50"))

    land_rows(spark, root, 2, "c", transactions=[SALE[0]], transaction_items=[SALE[1]])
    land_rows(spark, root, 3, "u", customers=[(31, "Renamed", "nora@mail.test", "NO", "2023-01-02")])
    land_rows(spark, root, 4, "d", category_ref=[("CDC", None)])
    outcome = run_changes(lake, root, datetime(2024, 5, 2))
    changed = {t for t, what in outcome.items() if what == "merged"}
    assert changed == {"transactions", "transaction_items", "customers", "category_ref"}
    assert facts(lake) == (7, Decimal("1756.50"))
    current = served(lake, "dim_customer").filter("customer_id = 31 AND is_current").first()
    assert current.full_name == "Renamed"
    codes = lake.read("bronze", "category_ref").filter("_state = 'live'")
    assert "CDC" not in {r.category_code for r in codes.collect()}

    outcome = run_changes(lake, root, datetime(2024, 5, 3))
    assert set(outcome.values()) == {"up to date", "no events"}
    assert facts(lake) == (7, Decimal("1756.50"))


def test_a_failed_table_fails_those_that_read_it_and_no_others(spark, tmp_path, monkeypatch):
    def broken(run):
        raise ValueError("no stores today")

    tables = [replace(t, build=broken) if t.name == "stores" else t for t in TABLES]
    monkeypatch.setattr("tillhouse.plans.pipeline.TABLES", tables)
    chosen = [("silver", n) for n in ("customers", "stores", "transactions", "sales", "products")]
    lake = Lake(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no stores today"):
        built_lake(spark, tmp_path, only=chosen)
    assert lake.exists("silver", "customers") and lake.exists("silver", "products")
    assert not lake.exists("silver", "sales")


def test_every_table_is_built(built):
    assert len(TABLES) == 18
    assert all(built.exists(*t.place) for t in TABLES)


def test_a_chosen_table_is_rebuilt_alone(spark, tmp_path):
    lake = built_lake(spark, tmp_path, only=[("silver", "stores")])
    build(lake, "2024-05-02", [("gold", "dim_store")])
    assert sorted(by(lake.read("gold", "dim_store"), "store_key")) == [5, 6]
    assert not lake.exists("silver", "sales")
