"""Slowly changing history (type 2): every observed version of every entity.

An entity gains at most one row per run, so a window or an aggregate over one entity's
history is bounded by the number of runs. A history table has one part per run: a run reads what the
runs before it wrote and writes its own new rows, nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.functions import moment, version_key
from tillhouse.schemas import BEGINNING, FOREVER, TRACKED_CUSTOMER_COLUMNS
from tillhouse.sources.lake import PART, Lake

KEY = "customer_id"


def first_capture(
    current: DataFrame, tracked: Sequence[str] = TRACKED_CUSTOMER_COLUMNS
) -> DataFrame:
    """History of the first run: every row has always been valid."""
    return current.select(
        *tracked, moment(BEGINNING).alias("valid_from"), F.lit(False).alias("is_deleted")
    )


def latest_versions(history: DataFrame, key: str = KEY) -> DataFrame:
    """The newest row of each entity, found by aggregation rather than by sorting."""
    others = [c for c in history.columns if c != key]
    return (
        history.groupBy(key)
        .agg(F.max_by(F.struct(*others), "valid_from").alias("_latest"))
        .select(*[F.col(c) if c == key else F.col(f"_latest.{c}") for c in history.columns])
    )


def compare(
    current: DataFrame,
    history: DataFrame,
    key: str = KEY,
    tracked: Sequence[str] = TRACKED_CUSTOMER_COLUMNS,
) -> DataFrame:
    """Entities that changed, appeared or disappeared, from one full join on the key.

    ``change`` is ``changed`` (a tracked value differs, the entity is new, or it is back
    after a delete) or ``removed``; ``known`` tells whether the history ever saw the id.
    Tracked columns hold the new values, or the last ones of a removed entity.
    """
    values = [c for c in tracked if c != key]
    new = current.select(key, F.lit(True).alias("_in_current"), *[F.col(c).alias(f"_new_{c}") for c in values])
    old = latest_versions(history.select(*tracked, "valid_from", "is_deleted"), key).select(
        key,
        F.lit(True).alias("_in_history"),
        "is_deleted",
        *[F.col(c).alias(f"_old_{c}") for c in values],
    )
    here = F.col("_in_current").isNotNull()
    known = F.col("_in_history").isNotNull()
    active = known & ~F.col("is_deleted")
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"_new_{c}").eqNullSafe(F.col(f"_old_{c}")) for c in values],
        F.lit(True),
    )
    change = F.when(here & ~(active & same), F.lit("changed")).when(
        ~here & active, F.lit("removed")
    )
    return (
        new.join(old, key, "full")
        .select(
            key,
            *[
                F.when(here, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)
                for c in values
            ],
            known.alias("known"),
            F.coalesce(change, F.lit("none")).alias("change"),
        )
        .filter(F.col("change") != "none")
    )


def changed(current, history, key=KEY, tracked=TRACKED_CUSTOMER_COLUMNS) -> DataFrame:
    """Current rows without an equal active version."""
    return compare(current, history, key, tracked).filter("change = 'changed'").select(*tracked)


def removed(current, history, key=KEY, tracked=TRACKED_CUSTOMER_COLUMNS) -> DataFrame:
    """Last values of active entities that are gone from the current rows."""
    return compare(current, history, key, tracked).filter("change = 'removed'").select(*tracked)


def new_versions(
    current: DataFrame,
    history: DataFrame | None,
    run_ts: datetime | str,
    key: str = KEY,
    tracked: Sequence[str] = TRACKED_CUSTOMER_COLUMNS,
) -> DataFrame:
    """The rows that this run's observations add to the history.

    A known entity's new version starts now; an unknown one's starts at the beginning, so
    facts dated before its first capture still find a version.
    """
    if history is None:
        return first_capture(current, tracked)
    kept = history.select(*tracked, "valid_from", "is_deleted").schema
    is_removed = F.col("change") == "removed"
    new = compare(current, history, key, tracked).select(
        *tracked,
        F.when(F.col("known"), moment(run_ts)).otherwise(moment(BEGINNING)).alias("valid_from"),
        is_removed.alias("is_deleted"),
    )
    return new.select(*[F.col(f.name).cast(f.dataType) for f in kept])


def append_versions(
    current: DataFrame,
    history: DataFrame | None,
    run_ts: datetime | str,
    key: str = KEY,
    tracked: Sequence[str] = TRACKED_CUSTOMER_COLUMNS,
) -> DataFrame:
    """The history with this run's observations added."""
    new = new_versions(current, history, run_ts, key, tracked)
    return new if history is None else history.select(*new.columns).unionByName(new)


def run_part(run_ts: datetime | str) -> str:
    """Name of the part of a history table that holds one run's rows."""
    when = run_ts if isinstance(run_ts, datetime) else datetime.fromisoformat(run_ts)
    return when.strftime("%Y%m%dT%H%M%S%f")


def publish_run(lake: Lake, new: DataFrame, layer: str, table: str, run_ts: datetime | str) -> None:
    """Add a run's rows to a history table as a part of their own. Earlier parts stay untouched, and a
    run that is repeated overwrites only its own."""
    part = run_part(run_ts)
    lake.publish_parts(new.withColumn(PART, F.lit(part)), layer, table, [part])


def before_run(lake: Lake, layer: str, table: str, run_ts: datetime | str) -> DataFrame | None:
    """The history without what this run wrote, if it ran before; None when there is no other."""
    if not lake.exists(layer, table):
        return None
    own = run_part(run_ts)
    earlier = [name for name in lake.version(layer, table).parts if name != own]
    return lake.read(layer, table, earlier) if earlier else None


def dimension(history: DataFrame, key: str = KEY) -> DataFrame:
    """Version number, validity range and surrogate key of each version.

    Delete markers are numbered and end the version before them, then leave.
    """
    order = Window.partitionBy(key).orderBy("valid_from")
    forever = moment(FOREVER)
    return (
        history.withColumn("version", F.row_number().over(order))
        .withColumn("valid_to", F.coalesce(F.lead("valid_from").over(order), forever))
        .filter(~F.col("is_deleted"))
        .withColumn("customer_key", version_key(F.col(key), F.col("version")))
        .withColumn("is_current", F.col("valid_to") == forever)
    )
