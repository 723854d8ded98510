from decimal import Decimal

from conftest import SHOP, SOLD, by, column, frame

from tillhouse.operators.dedupe import dedupe_by_key, survivor_map, survivors
from tillhouse.plans.run import Run
from tillhouse.plans import silver


def test_customers_are_deduplicated_cleaned_and_translated(built):
    rows = by(built.read("silver", "customers"), "customer_id")
    assert sorted(rows) == [110, 120, 140]
    assert (rows[110].full_name, rows[110].email) == ("Ines Moreau", "ines@mail.test")
    assert rows[120].full_name == "Tom Reed"
    assert {i: (r.country_code, r.country_name) for i, r in rows.items()} == {
        110: ("PT", "Portugal"), 120: ("NZ", "New Zealand"), 140: ("QQ", "Unknown"),
    }


def test_products_keep_the_survivors_own_row_and_drop_invalid_prices(built):
    rows = by(built.read("silver", "products"), "product_id")
    assert {i: (r.product_name, r.category_name, r.unit_price) for i, r in rows.items()} == {
        21: ("Rake", "tools", Decimal("18.40")),
        22: ("Seeds", "plants", Decimal("3.15")),
        25: ("Gift", "Unknown", Decimal("7.77")),
    }


def test_stores_are_trimmed(built):
    rows = by(built.read("silver", "stores"), "store_id")
    assert tuple(rows[5]) == (5, "Harbour", "Porto", "PT", "Portugal")


def test_only_completed_transactions_stay(built):
    rows = by(built.read("silver", "transactions"), "transaction_id")
    assert {i: (r.status, r.customer_id) for i, r in rows.items()} == {
        301: ("completed", 110), 302: ("completed", 120), 303: ("completed", 110), 304: ("completed", 140),
    }


def test_sales_follow_survivors_and_keep_the_charged_price(built):
    rows = by(built.read("silver", "sales"), "item_id")
    assert {i: r.line_amount for i, r in rows.items()} == SOLD
    assert (rows[4004].customer_id, rows[4004].product_id, rows[4004].unit_price) == (110, 22, Decimal("3.60"))


def test_sales_and_rejected_sales_make_up_all_completed_items(built):
    rejected = column(built.read("silver", "rejected_sales"), "item_id")
    assert rejected == [4006]
    completed = {t for t, *_, status, _ in SHOP["transactions"] if status == "OK"}
    assert sorted([*SOLD, *rejected]) == [i for i, t, *_ in SHOP["transaction_items"] if t in completed]


def test_transactions_of_unknown_parties_make_no_sales(spark):
    """A transaction whose store is unknown is kept, and its items are rejected."""
    tables = {("bronze", t): frame(spark, t, rows) for t, rows in SHOP.items()}
    tables["bronze", "transactions"] = frame(
        spark, "transactions", [(301, 77, 110, "2024-02-28", "OK", "CARD")]
    )
    run = Run(lambda layer, table: tables[layer, table], lambda *_: False, "2026-09-15 12:00:00")
    for name in ("customers", "stores", "transactions", "sales"):
        tables["silver", name] = getattr(silver, name)(run)
    assert column(tables["silver", "transactions"], "transaction_id") == [301]
    assert column(tables["silver", "sales"], "item_id") == []
    assert column(silver.rejected_sales(run), "item_id") == [4001, 4002]


def test_dedupe_takes_the_first_row_by_all_other_columns_nulls_first(spark):
    df = spark.createDataFrame(
        [(1, "b", 2), (1, "b", 1), (1, None, 9), (2, "x", 1), (None, "n", 1), (None, "m", 1)],
        "k INT, a STRING, b INT",
    )
    rows = {tuple(r) for r in dedupe_by_key(df, "k").collect()}
    assert rows == {(1, None, 9), (2, "x", 1), (None, "m", 1)}


def test_rows_without_a_natural_key_are_one_group_that_maps_no_id(spark):
    df = spark.createDataFrame(
        [(4, None), (1, None), (2, "e"), (3, "e")], "id INT, email STRING"
    )
    kept = {r.email: r.id for r in survivors(df, ["email"], "id").collect()}
    assert kept == {None: 1, "e": 2}
    assert sorted(map(tuple, survivor_map(df, ["email"], "id", "s").collect())) == [(2, 2), (3, 2)]
