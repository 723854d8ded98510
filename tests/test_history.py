"""Customer history: which runs add versions, and what facts make of them."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import FIRST_RUN, REVENUE, SHOP, SOLD, built_lake, by, column, frames
from pyspark.sql import functions as F

from tillhouse.operators import history
from tillhouse.plans.pipeline import build, load_snapshot

PEOPLE = [("silver", "customers"), ("silver", "customer_history"), ("gold", "dim_customer")]
BEGINNING = datetime(1970, 1, 1)
HISTORY = ("silver", "customer_history")


def customers(**changes):
    """The shop's customers with other countries; ``None`` removes one, a new id adds one."""
    rows = {r[0]: r for r in SHOP["customers"]}
    for name, country in changes.items():
        number = int(name[1:])
        if country is None:
            rows.pop(number)
        else:
            old = rows.get(number, (number, f"Person {number}", f"p{number}@mail.test", "", "2024-01-01"))
            rows[number] = (*old[:3], country, old[4])
    return list(rows.values())


def observe(lake, when, only=PEOPLE, **changes):
    load_snapshot(lake, frames(lake.spark, customers=customers(**changes)), when)
    build(lake, when, only)


def versions(lake, number):
    rows = lake.read("gold", "dim_customer").filter(F.col("customer_id") == number).orderBy("version").collect()
    return [(r.version, r.country, r.valid_from, r.valid_to, r.is_current) for r in rows]


@pytest.fixture
def people(spark, tmp_path):
    return built_lake(spark, tmp_path / "lake", only=PEOPLE)


def test_first_observation_is_valid_from_the_beginning(built):
    rows = built.read("gold", "dim_customer").collect()
    assert {r.customer_key for r in rows} == {n * 1_000_000 + 1 for n in (110, 120, 140)}
    assert {(r.version, r.valid_from, r.is_current) for r in rows} == {(1, BEGINNING, True)}


def test_moves_removals_returns_and_new_customers_over_five_runs(people):
    """120 moves twice, 140 leaves and comes back, 150 appears, 110 stays as it is."""
    days = [FIRST_RUN + timedelta(days=3 * n) for n in range(1, 6)]
    observe(people, days[0], c120="PT")
    observe(people, days[1], c120="PT", c140=None)
    observe(people, days[2], c120="PT", c140=None, c150="NZ")
    observe(people, days[3], c120="NZ", c150="NZ")
    observe(people, days[4], c120="NZ", c150="NZ")
    forever = versions(people, 110)[0][3]
    assert versions(people, 110) == [(1, "Portugal", BEGINNING, forever, True)]
    assert versions(people, 120) == [
        (1, "New Zealand", BEGINNING, days[0], False),
        (2, "Portugal", days[0], days[3], False),
        (3, "New Zealand", days[3], forever, True),
    ]
    # The delete marker took number 2 and ends version 1; between them there is a gap.
    assert versions(people, 140) == [
        (1, "Unknown", BEGINNING, days[1], False),
        (3, "Unknown", days[3], forever, True),
    ]
    assert versions(people, 150) == [(1, "New Zealand", BEGINNING, forever, True)]


def history_files(lake):
    return {p for p in Path(lake.root).rglob("silver/customer_history/**/*.parquet")}


def test_a_run_writes_its_own_part_and_leaves_the_others(people):
    before = history_files(people)
    day = FIRST_RUN + timedelta(days=1)
    observe(people, day, c120="PT")
    added = history_files(people) - before
    assert before <= history_files(people)
    assert added and all(history.run_part(day) in str(f) for f in added)
    assert people.version(*HISTORY).rows[history.run_part(day)] == 1


def test_a_run_without_changes_writes_no_row(people):
    before = history_files(people)
    observe(people, FIRST_RUN + timedelta(days=1))
    assert history_files(people) == before
    assert people.read(*HISTORY).count() == 3


def test_a_repeated_run_overwrites_only_what_it_wrote(people):
    day = FIRST_RUN + timedelta(days=1)
    observe(people, day, c120="PT")
    observe(people, day, c120="NZ", c140="PT")  # the same run, with what the source says by now
    assert [v[1] for v in versions(people, 120)] == ["New Zealand"]
    assert [v[1] for v in versions(people, 140)] == ["Unknown", "Portugal"]


def test_sales_keep_the_version_of_their_date(spark, tmp_path):
    """A move after the sales leaves them alone, one before them takes them along."""
    for when, key in ((datetime(2024, 6, 1), 120_000_001), (datetime(2024, 1, 1), 120_000_002)):
        lake = built_lake(spark, tmp_path / str(key))
        observe(lake, when, only=None, c120="PT")
        fact = lake.read("gold", "fact_sales")
        assert by(fact, "item_key")[4003].customer_key == key
        assert (fact.count(), fact.agg(F.sum("line_amount")).first()[0]) == (len(SOLD), REVENUE)
        mart = by(lake.read("mart", "customer_sales_mart"), "customer_key")
        assert 120_000_001 not in mart and mart[120_000_002].country == "Portugal"


def test_nulls_compare_equal(spark):
    tracked = ("customer_id", "note")
    make = lambda *rows: spark.createDataFrame(list(rows), "customer_id INT, note STRING")
    known = history.append_versions(make((8, None), (9, "x")), None, FIRST_RUN, tracked=tracked)
    assert history.new_versions(make((8, None), (9, "x")), known, FIRST_RUN, tracked=tracked).isEmpty()
    assert column(history.changed(make((8, "y"), (9, "x")), known, tracked=tracked), "customer_id") == [8]
    assert column(history.changed(make((8, None), (9, None)), known, tracked=tracked), "customer_id") == [9]
    assert history.removed(make((8, None), (9, None)), known, tracked=tracked).isEmpty()
