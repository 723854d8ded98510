"""The pipeline composed over one test-data directory."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.operators import history
from tillhouse.operators.lookup import translate
from tillhouse.plans import silver
from tillhouse.plans.pipeline import TABLES
from tillhouse.plans.run import Run, together
from tillhouse.schemas import TRACKED_CUSTOMER_COLUMNS
from tillhouse.session import shared_dir
from tillhouse.sources.lake import Lake
from tillhouse.sources.retail_views import retail_table

# When the three customer snapshots were observed; inside the range of sale dates, so that
# sales spread over versions and over the gap of a removed customer.
RUNS = (
    datetime(1996, 6, 1, 9, 30),
    datetime(1998, 1, 1, 9, 30),
    datetime(2000, 1, 1, 9, 30),
)

_TABLES = {(t.layer, t.name): t for t in TABLES}
HISTORY = ("silver", "customer_history")
# What the builder of each table reads, as recorded when it was first planned.
_READS: dict[tuple[str, str], set[tuple[str, str]]] = {}


class Retail:
    """Tables over the source views, each built the way a run builds it: from published
    inputs. A query publishes the inputs it needs, and no others, to a lake of its own.

    The customer history is that of three snapshots of the whole customer table.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self.lake = Lake(spark, shared_dir(spark, "lake"))
        self.run = Run(self.stored, lambda layer, table: True, RUNS[-1])
        self._open: dict[tuple[str, str], DataFrame] = {}
        self._drafts: dict[tuple[str, str], DataFrame] = {}

    def read(self, layer: str, table: str) -> DataFrame:
        """The plan of one table over its published inputs."""
        if layer in ("ingestion", "bronze"):
            return retail_table(self.spark, self.directory, table)
        self._publish(self._inputs((layer, table)))
        return self._plan((layer, table))

    def stored(self, layer: str, table: str) -> DataFrame:
        """The published table; source tables are files already."""
        place = (layer, table)
        if place not in self._open:
            if layer in ("ingestion", "bronze"):
                self._open[place] = self.read(layer, table)
            else:
                self._publish({place})
                self._open[place] = self.lake.read(layer, table)
        return self._open[place]

    def _plan(self, place: tuple[str, str]) -> DataFrame:
        if place == HISTORY:
            return self.history(len(RUNS))
        return _TABLES[place].build(self.run)

    def _inputs(self, place: tuple[str, str]) -> set[tuple[str, str]]:
        if place == HISTORY:
            return set()
        if place not in _READS:
            self._draft(place)
        return _READS[place]

    def _draft(self, place: tuple[str, str]) -> DataFrame:
        """A table's plan down to the source views, never run; records what builders read."""
        reads: set[tuple[str, str]] = set()

        def read(layer: str, table: str) -> DataFrame:
            if layer == "bronze":
                return retail_table(self.spark, self.directory, table)
            reads.add((layer, table))
            if (layer, table) not in self._drafts:
                self._drafts[layer, table] = self._draft((layer, table))
            return self._drafts[layer, table]

        plan = _TABLES[place].build(Run(read, lambda *_: False, RUNS[-1]))
        _READS[place] = reads
        return plan

    def _publish(self, places: set[tuple[str, str]]) -> None:
        """Publish tables and what they need, those that are ready at the same time."""
        missing: set[tuple[str, str]] = set()
        found = set(places)
        while found:
            missing |= {p for p in found if p == HISTORY or not self.lake.exists(*p)}
            found = {i for p in found for i in self._inputs(p)} - missing
        while missing:
            ready = [p for p in missing if not self._inputs(p) & missing]
            together(partial(self._publish_one, p) for p in ready)
            missing -= set(ready)

    def _publish_one(self, place: tuple[str, str]) -> None:
        if place == HISTORY:
            self.history(len(RUNS))
        else:
            table = _TABLES.get(place)
            self.lake.publish(self._plan(place), *place, bucket_by=table.bucket_by if table else None)

    def snapshot(self, number: int) -> DataFrame:
        """Customers as the source showed them at one of three times.

        The second adds customers, removes some and moves others to another country; the
        third brings some of the removed ones back.
        """
        people = silver.clean_customers(self.run)
        key = F.col("customer_id")
        stays = key % 11 != 5
        returns = (key % 22 == 5) & (key % 20 != 0)
        if number == 1:
            people = people.filter(key % 20 != 0)
        else:
            elsewhere = F.when(F.col("country_code") == "N00", "N01").otherwise("N00")
            people = people.filter(stays if number == 2 else stays | returns).withColumn(
                "country_code",
                F.when(key % 10 == 3, elsewhere).otherwise(F.col("country_code")),
            )
        named = translate(
            people, self.run.source("country_ref"), "country_code", "country_name"
        )
        return named.select(*TRACKED_CUSTOMER_COLUMNS)

    def history(self, runs: int) -> DataFrame:
        """Customer history after the first one, two or three snapshots. Each run adds a part to
        the table that the runs before it left."""
        for run in RUNS[:runs]:
            done = self.lake.version(*HISTORY).parts if self.lake.exists(*HISTORY) else {}
            if history.run_part(run) not in done:
                earlier = history.before_run(self.lake, *HISTORY, run)
                rows = history.new_versions(self.snapshot(RUNS.index(run) + 1), earlier, run)
                history.publish_run(self.lake, rows, *HISTORY, run)
        return self.lake.read(*HISTORY, [history.run_part(run) for run in RUNS[:runs]])
