"""Merging change events into a table.

A change table holds the source columns plus ``_ingested_at``, ``_cdc_ts`` (time of the
event behind the row), ``_position`` (where that event landed, if known) and ``_state``. A deleted key stays as a row in state ``gone``, so an
older event that arrives late cannot bring it back; ``live`` hides those rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillhouse.functions import day_of, moment

LIVE, GONE = "live", "gone"
POSITION = "_position"
POSITION_TYPE = "struct<file_path:string,row_index:bigint>"


def _position(df: DataFrame) -> Column:
    """Where the event behind a row landed; null in frames that do not know."""
    known = F.col(POSITION) if POSITION in df.columns else F.lit(None)
    return known.cast(POSITION_TYPE).alias(POSITION)


def _typed(field: T.StructField) -> Column:
    value = F.col(f"value.after.{field.name}")
    if isinstance(field.dataType, T.DateType):
        return day_of(value)
    return value.cast(field.dataType)


def latest_events(
    events: DataFrame, columns: T.StructType, key: str, since: int | None = None
) -> DataFrame:
    """The newest event of each key after ``since``: typed columns, ``_key``,
    ``_is_delete``, ``_cdc_ts`` and ``_position``.

    The greatest struct per key is aggregated before the shuffle, so a key with very many
    events costs one row per task. Equal times are decided by the landing position when the
    frame has one, then by the event's content; never by chance.
    """
    if since is not None:
        events = events.filter(F.col("value.ts_ns") > F.lit(since))
    newest = events.groupBy(
        F.coalesce(F.col(f"value.after.{key}"), F.col(f"value.before.{key}"))
        .cast(columns[key].dataType)
        .alias("_key")
    ).agg(
        F.max(
            F.struct(
                F.col("value.ts_ns").alias("_cdc_ts"),
                _position(events),
                (F.col("value.op") == "d").alias("_is_delete"),
                F.struct(*[_typed(f).alias(f.name) for f in columns]).alias("_row"),
            )
        ).alias("_newest")
    )
    return newest.select(
        *[F.col(f"_newest._row.{f.name}") for f in columns],
        "_key",
        "_newest._is_delete",
        "_newest._cdc_ts",
        f"_newest.{POSITION}",
    )


def as_rows(
    latest: DataFrame, columns: T.StructType, key: str, run_ts: datetime | str
) -> DataFrame:
    """Newest events in the shape of the change table."""
    return latest.select(
        *[
            (F.col("_key") if f.name == key else F.col(f.name)).alias(f.name)
            for f in columns
        ],
        moment(run_ts).alias("_ingested_at"),
        "_cdc_ts",
        POSITION,
        F.when(F.col("_is_delete"), F.lit(GONE)).otherwise(F.lit(LIVE)).alias("_state"),
    )


def empty_rows(spark, columns: T.StructType) -> DataFrame:
    """An empty change table with its full schema."""
    extra = f"_ingested_at TIMESTAMP_NTZ, _cdc_ts BIGINT, {POSITION} {POSITION_TYPE}, _state STRING"
    fields = [*columns.fields, *T.StructType.fromDDL(extra).fields]
    return spark.createDataFrame([], T.StructType(fields))


def live(state: DataFrame) -> DataFrame:
    """What readers see: rows that exist now."""
    return state.filter(F.col("_state") == LIVE).drop("_state", POSITION)


def high_water_mark(state: DataFrame) -> DataFrame:
    """Time of the newest applied event, zero when there is none. One row."""
    return state.agg(F.coalesce(F.max("_cdc_ts"), F.lit(0).cast("bigint")).alias("high_water"))


def high_water(state: DataFrame) -> int:
    return high_water_mark(state).first().high_water


def rebuild_from_events(
    events: DataFrame, columns: T.StructType, key: str, run_ts: datetime | str
) -> DataFrame:
    """A change table from the full topic."""
    return as_rows(latest_events(events, columns, key), columns, key, run_ts)


def fresh_rows(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of a batch of newest rows, one per key, that the table does not have yet.

    A row applies when its event is newer than that of the row it meets, or as old and landed
    behind it, so applying a batch again, or out of order, ends in the same table. Of equal times
    without known positions the first applied stays. Keys and times are all this reads of the table; a
    batch whose size allows it is broadcast, and the table is then scanned, not shuffled.
    """
    applied = state.select(
        key, F.col("_cdc_ts").alias("_applied_ts"), _position(state).alias("_applied_at")
    )
    behind = F.coalesce(F.col(POSITION) > F.col("_applied_at"), F.lit(False))
    tie = F.col("_applied_ts") == F.col("_cdc_ts")
    stale = (
        batch.select(key, "_cdc_ts", POSITION)
        .join(applied, key)
        .filter((F.col("_applied_ts") > F.col("_cdc_ts")) | (tie & ~behind))
        .select(key)
    )
    return batch.join(stale, key, "left_anti")


def replace_rows(state: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The change table with the rows of ``fresh`` in place of those of the same keys."""
    untouched = state.join(fresh.select(key), key, "left_anti")
    same = [_position(state) if c == POSITION else F.col(c) for c in fresh.columns]
    return untouched.select(*same).unionByName(fresh)


def apply_batch(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The change table after a batch of newest rows, one per key (see ``fresh_rows``)."""
    return replace_rows(state, fresh_rows(state, batch, key), key)


def merge_events(
    state: DataFrame,
    events: DataFrame,
    columns: T.StructType,
    key: str,
    run_ts: datetime | str,
    since: int | None = None,
) -> DataFrame:
    """The change table after applying events: deletes, updates and inserts by key."""
    batch = as_rows(latest_events(events, columns, key, since), columns, key, run_ts)
    return apply_batch(state, batch, key)
