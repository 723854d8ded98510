"""What a table builder sees of the run it belongs to."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from tillhouse.operators.changes import live
from tillhouse.operators.dedupe import dedupe_by_key
from tillhouse.schemas import primary_key, source_schema
from tillhouse.sources.lake import Lake


@dataclass(frozen=True)
class Run:
    """``read`` and ``exists`` address tables by (layer, name); ``run_ts`` is the one time
    at which this run observed its data."""

    read: Callable[[str, str], DataFrame]
    exists: Callable[[str, str], bool]
    run_ts: datetime | str

    def source(self, table: str) -> DataFrame:
        """Source columns of a bronze table, one row per primary key.

        Load metadata goes first, so tables can be joined without clashing columns.
        """
        columns = source_schema(table).names
        return dedupe_by_key(self.read("bronze", table).select(*columns), primary_key(table))


def lake_run(lake: Lake, run_ts: datetime | str) -> Run:
    """A run over published tables. Bronze tables that change events maintain show only
    their live rows."""

    def read(layer: str, table: str) -> DataFrame:
        df = lake.read(layer, table)
        return live(df) if "_state" in df.columns else df

    return Run(read, lake.exists, run_ts)


def together(jobs: Iterable[Callable[[], object]], threads: int = 8) -> list:
    """Run independent Spark jobs at the same time, so that small tables do not leave the
    cluster idle. The first failure is raised once all have ended."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        started = [pool.submit(job) for job in jobs]
    return [job.result() for job in started]
