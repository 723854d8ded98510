"""Bring bronze up to date from landed change events, by polling or as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillhouse.operators.changes import (
    LIVE,
    POSITION,
    as_rows,
    empty_rows,
    fresh_rows,
    latest_events,
    rebuild_from_events,
    replace_rows,
)
from tillhouse.schemas import event_schema, primary_key, source_schema
from tillhouse.sources.lake import PART, Lake

LAYER = "bronze"
# Newest rows of the batch being merged.
BATCHES = "change_batches"
# Parts of a change table that is built anew.
PARTS = 16


def landing_glob(root: str, table: str, topic_prefix: str = "demo.pos.") -> str:
    """Folders of a table's event files: ``cdc/<topic>/<partition>/<offset>.parquet``."""
    return f"{root.rstrip('/')}/cdc/{topic_prefix}{table}/*"


def landed_files(spark: SparkSession, glob: str, after: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Event files by folder (one per topic partition), in offset order; with ``after``, only those
    behind the last one known of their folder. Files are listed, not opened.

    A file is named by the padded offset of its first event. Other names have no order, so
    whether such a file is new cannot be told: they are refused.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for folder in fs.globStatus(path) or []:
        last = (after or {}).get(folder.getPath().getName(), "")
        entries = fs.listStatusIterator(folder.getPath())
        while entries.hasNext():
            file = entries.next().getPath()
            name = file.getName()
            if not name.endswith(".parquet") or name <= last:
                continue
            if not name.split(".")[0].isdigit():
                raise ValueError(f"{file.toString()} is not named by an offset")
            found.setdefault(folder.getPath().getName(), []).append(file.toString())
    return {folder: sorted(files) for folder, files in found.items()}


def _with_position(events: DataFrame) -> DataFrame:
    """Add where an event landed. File names carry the padded offset of their first event,
    and all events of a key share one topic partition."""
    return events.select(
        "value", F.struct("_metadata.file_path", "_metadata.row_index").alias(POSITION)
    )


def _utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class ChangeFeed:
    """One bronze table maintained from its change events.

    The table is cut into parts by a hash of its key. A batch reads and writes only the parts that its
    fresh rows fall in; the files of the others stay (see ``Lake.publish_parts``). The version keeps what
    has been applied: the last file of each topic partition (polls) and the last batch of
    each stream, so neither is applied twice. ``parts`` counts for a table that is built anew: one
    part is what a single changed row rewrites.
    """

    def __init__(self, lake: Lake, table: str, columns=None, key: str | None = None, parts: int = PARTS):
        self.lake = lake
        self.table = table
        self.columns = columns or source_schema(table)
        self.key = key or primary_key(table)
        self.parts = parts
        self.opened: list[str] = []  # files that the last poll read

    @property
    def spark(self) -> SparkSession:
        return self.lake.spark

    def state(self) -> DataFrame:
        """The table with its delete markers."""
        return self.lake.read(LAYER, self.table)

    def _resumable(self) -> bool:
        """A table without event times comes from full refreshes and must be replaced."""
        if not self.lake.exists(LAYER, self.table):
            return False
        version = self.lake.version(LAYER, self.table)
        return "parts" in version.facts and any(f["name"] == "_cdc_ts" for f in version.schema["fields"])

    def _facts(self) -> dict:
        return self.lake.version(LAYER, self.table).facts

    @staticmethod
    def _is_live() -> Column:
        return F.col("_state") == LIVE

    def _placed(self, rows: DataFrame, parts: int) -> DataFrame:
        return rows.withColumn(PART, F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("string"))

    def _rebuild(self, rows: DataFrame, facts: dict) -> None:
        names = [str(n) for n in range(self.parts)]
        self.lake.publish_parts(
            self._placed(rows, self.parts), LAYER, self.table, names, self._is_live(), {"parts": self.parts, **facts}, replace=True
        )

    def events(self, *paths: str) -> DataFrame:
        return _with_position(self.spark.read.schema(event_schema(self.columns)).parquet(*paths))

    def poll(self, glob: str, run_ts: datetime | None = None) -> str:
        """Apply the files that landed behind those applied. Returns what happened: ``no
        events``, ``rebuilt``, ``merged`` or ``up to date``."""
        now = run_ts or _utc_now()
        resumable = self._resumable()
        offsets = self._facts().get("offsets", {}) if resumable else {}
        files = landed_files(self.spark, glob, offsets)
        self.opened = [f for folder in files.values() for f in folder]
        if not self.opened:
            if not self.lake.exists(LAYER, self.table):
                self._rebuild(empty_rows(self.spark, self.columns), {})
            return "up to date" if offsets else "no events"
        facts = {"offsets": {**offsets, **{d: f[-1].rsplit("/", 1)[1] for d, f in files.items()}}}
        events = self.events(*self.opened)
        if not resumable:
            self._rebuild(rebuild_from_events(events, self.columns, self.key, now), facts)
            return "rebuilt"
        if self._merge(latest_events(events, self.columns, self.key), now, facts):
            return "merged"
        # Nothing new in them, but they need not be opened again.
        self.lake.publish_parts(self._placed(self.state(), 1), LAYER, self.table, [], facts=facts)
        return "up to date"

    def _merge(self, newest: DataFrame, now: datetime, facts: dict | None = None) -> bool:
        """Apply the newest event of each key. These rows are written first, then those of them that
        are fresh: each is computed once, and Spark plans the merge with their true size."""
        parts = self._facts()["parts"]
        batch = self._stored(self._placed(as_rows(newest, self.columns, self.key, now), parts), self.table)
        fresh = fresh_rows(self.lake.read(LAYER, self.table, _names(batch)), batch, self.key)
        fresh = self._stored(fresh, f"{self.table}_fresh")
        names = _names(fresh)
        if not names:
            return False
        merged = replace_rows(self.lake.read(LAYER, self.table, names), fresh.drop(PART), self.key)
        self.lake.publish_parts(self._placed(merged, parts), LAYER, self.table, names, self._is_live(), facts)
        return True

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        self.lake.publish(rows, BATCHES, name)
        return self.lake.read(BATCHES, name)

    def apply(
        self,
        events: DataFrame,
        run_ts: datetime | None = None,
        glob: str | None = None,
        batch: tuple[str, int] | None = None,
    ) -> str:
        """Merge one batch of events whatever their age; each row takes only newer ones, so
        a batch that is delivered again changes and publishes nothing. A table that comes from full
        refreshes is replaced from everything that has landed at ``glob``, not from this batch.

        ``batch`` names a stream and the number of its batch. The version keeps it, and a batch that
        was applied already is not even read.
        """
        now = run_ts or _utc_now()
        resumable = self._resumable()
        applied = self._facts().get("applied", {}) if resumable else {}
        if batch and applied.get(batch[0], -1) >= batch[1]:
            return "applied before"
        facts = {"applied": {**applied, batch[0]: batch[1]}} if batch else {}
        if resumable:
            merged = self._merge(latest_events(events, self.columns, self.key), now, facts)
            return "merged" if merged else "up to date"
        events = self.events(glob) if glob else events
        self._rebuild(rebuild_from_events(events, self.columns, self.key, now), facts)
        return "rebuilt"

    def _reader(self, max_files_per_batch: int | None):
        reader = self.spark.readStream.schema(event_schema(self.columns))
        return reader.option("maxFilesPerTrigger", max_files_per_batch) if max_files_per_batch else reader

    def _stream_id(self, checkpoint: str) -> str:
        """The id that Spark gave the stream of a checkpoint when it first started."""
        return json.loads(self.spark.read.text(f"{checkpoint}/metadata").first().value)["id"]

    def stream(
        self,
        glob: str,
        checkpoint: str,
        clock: Callable[[], datetime] = _utc_now,
        max_files_per_batch: int | None = None,
    ) -> StreamingQuery:
        """Apply every file that has landed since the checkpoint, then stop.

        The checkpoint remembers files rather than times, so events that land late are
        applied too. A batch repeated after a failure is known by its number (see ``apply``).
        """

        def apply(batch: DataFrame, number: int) -> None:
            self.apply(batch, clock(), glob, (self._stream_id(checkpoint), number))

        return (
            _with_position(self._reader(max_files_per_batch).parquet(glob))
            .writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def state_stream(
        self,
        glob: str,
        checkpoint: str,
        clock: Callable[[], datetime] = _utc_now,
        max_files_per_batch: int | None = None,
    ) -> StreamingQuery:
        """The same table as a view of streaming state: the state store holds the newest event of each
        key, and a batch emits only the keys whose newest event it changed (update mode).

        The checkpoint restores the state after a stop. What has been emitted is merged like any batch, so
        a batch that is emitted again changes nothing. The state grows with the number of keys, deleted
        ones included: a late event of a deleted key must still find it.
        """
        events = _with_position(self._reader(max_files_per_batch).parquet(glob))

        def merge(newest: DataFrame, number: int) -> None:
            if self._resumable():
                self._merge(newest, clock())
                return
            # Written in any case: a state store counts a batch only when all of it was computed.
            rows = self._stored(as_rows(newest, self.columns, self.key, clock()), self.table)
            if number:
                # A table of full refreshes took the place of what was emitted before: read it again.
                rows = rebuild_from_events(self.events(glob), self.columns, self.key, clock())
            self._rebuild(rows, {})

        return (
            latest_events(events, self.columns, self.key)
            .writeStream.outputMode("update")
            .foreachBatch(merge)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def _names(rows: DataFrame) -> list[str]:
    """Parts that rows fall in: never more than the table has."""
    return [r[PART] for r in rows.select(PART).distinct().collect()]
