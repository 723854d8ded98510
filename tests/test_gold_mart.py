from datetime import date

from conftest import REVENUE, SHOP, by, built_lake

from tillhouse.operators.calendar import full_calendar
from tillhouse.plans.checks import FOREIGN_KEYS


def total(df, name):
    return df.agg({name: "sum"}).first()[0]


def test_revenue_is_exact(built):
    assert total(built.read("gold", "fact_sales"), "line_amount") == REVENUE


def test_doubled_source_rows_change_nothing(spark, built, tmp_path):
    """Every source row twice: all derived tables stay the same, row for row."""
    doubled = built_lake(spark, tmp_path, **{t: rows * 2 for t, rows in SHOP.items()})
    from tillhouse.plans.pipeline import TABLES

    for t in TABLES:
        once = sorted(map(str, built.read(t.layer, t.name).collect()))
        assert sorted(map(str, doubled.read(t.layer, t.name).collect())) == once, t.name


def test_calendar_is_full(built):
    rows = by(built.read("gold", "dim_date"), "date_key")
    assert len(rows) == 366
    day = rows[date(2024, 2, 29)]
    assert (day.year, day.quarter, day.month, day.day) == (2024, 1, 2, 29)
    assert (day.month_name, day.day_name, day.day_of_week, day.is_weekend) == ("February", "Thursday", 4, False)
    assert rows[date(2024, 3, 3)].is_weekend and rows[date(2024, 3, 3)].day_of_week == 7


def test_calendar_of_no_dates_is_the_year_of_the_run(spark):
    empty = spark.createDataFrame([], "d DATE")
    days = full_calendar([empty, empty], "2024-05-01 00:00:00")
    assert days.count() == 366 and days.agg({"date_key": "min"}).first()[0] == date(2024, 1, 1)


def test_facts_resolve_against_every_dimension(built):
    fact = built.read("gold", "fact_sales")
    assert fact.count() == built.read("silver", "sales").count()
    for key, dim in FOREIGN_KEYS.items():
        assert fact.join(built.read("gold", dim), key, "left_anti").count() == 0, key


def test_daily_mart_counts_transactions_once(built):
    rows = by(built.read("mart", "daily_sales_mart").filter("store_name = 'Harbour'"), "date_key")
    first = rows[date(2024, 2, 28)]
    assert (str(first.revenue), first.units_sold, first.transaction_count) == ("68.30", 12, 1)


def test_marts_agree_with_the_fact_and_have_one_row_per_grain(built):
    for table, measure, grain in (
        ("daily_sales_mart", "revenue", ["date_key", "store_name"]),
        ("product_sales_mart", "revenue", ["category", "product_name"]),
        ("customer_sales_mart", "total_spent", ["customer_key"]),
    ):
        mart = built.read("mart", table)
        assert total(mart, measure) == REVENUE, table
        assert mart.count() == mart.select(*grain).distinct().count(), table


def test_money_is_decimal_everywhere(built):
    for layer, table in (("silver", "sales"), ("gold", "fact_sales"), ("mart", "daily_sales_mart")):
        kinds = {t for _, t in built.read(layer, table).dtypes}
        assert "double" not in kinds and "float" not in kinds
