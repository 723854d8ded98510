"""Tables addressed by (layer, name), published as whole versions made of parts.

A part is one parquet directory that Spark wrote. A version is a marker file, created last, that
lists its parts, their schema, how many rows each holds, and facts that the writer wants to keep with
the data. Most versions have one part; ``publish_parts`` writes only the parts that changed, and its
version takes the others over from the one before, file by file untouched.

The newest directory with a marker is the table: a failed or unfinished write is never seen, readers
keep the version they opened, and no rename is needed, which object stores lack. A table may be built
from its own current version. One writer per table is assumed; a second one fails on the existing directory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection, Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "_SUCCESS"
WHOLE = "whole"
PART = "_part"
# Columns of numbers, as most of the lake's are, take up about a quarter less than with Spark's default.
CODEC = {"compression": "zstd"}


@dataclass(frozen=True)
class Version:
    """What a marker holds. ``parts``: name and folder below the table's; ``rows``: by part, as
    counted while the part was written; ``facts``: whatever the writer keeps with the data."""

    schema: dict
    parts: dict[str, str]
    rows: dict[str, int]
    facts: dict = field(default_factory=dict)

    @property
    def row_count(self) -> int:
        return sum(self.rows.values())


class Lake:
    def __init__(self, spark: SparkSession, root: str, keep_versions: int = 2):
        if keep_versions < 1:
            raise ValueError("keep_versions must be at least 1")
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep_versions = keep_versions

    # Listing, deletion and markers go through Hadoop's file system API, which is what
    # the session itself uses for every supported store.
    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _table(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _attempts(self, layer: str, table: str) -> list[int]:
        names = self._names(self._table(layer, table))
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _marker(self, layer: str, table: str, number: int):
        return self._path(f"{self._table(layer, table)}/v{number:08d}/{MARKER}")

    def versions(self, layer: str, table: str) -> list[int]:
        """Finished versions, oldest first."""
        fs = self._fs()
        return [v for v in self._attempts(layer, table) if fs.exists(self._marker(layer, table, v))]

    def exists(self, layer: str, table: str) -> bool:
        return bool(self.versions(layer, table))

    def version(self, layer: str, table: str, number: int | None = None) -> Version:
        """The marker of a version, by default the newest."""
        if number is None:
            found = self.versions(layer, table)
            if not found:
                raise LookupError(f"{layer}.{table} has not been published")
            number = found[-1]
        stream = self._fs().open(self._marker(layer, table, number))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def read(self, layer: str, table: str, parts: Collection[str] | None = None) -> DataFrame:
        """The newest version, or only the named parts of it."""
        version = self.version(layer, table)
        folders = [f for name, f in version.parts.items() if parts is None or name in parts]
        schema = T.StructType.fromJson(version.schema)
        if not folders:
            return self.spark.createDataFrame([], schema)
        if "buckets" in version.facts and len(folders) == 1:
            return self._bucketed(f"{self._table(layer, table)}/{folders[0]}", schema, *version.facts["buckets"])
        return self.spark.read.schema(schema).parquet(*[f"{self._table(layer, table)}/{f}" for f in folders])

    def _bucketed(self, path: str, schema: T.StructType, column: str, buckets: int) -> DataFrame:
        """A bucketed part. Spark knows buckets by a catalog entry only: this session's is made anew."""
        name = _entry(path)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) "
            f"SORTED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(name)

    def numbered(self, layer: str, table: str, into: str) -> DataFrame:
        """A table that was published ``sort_by`` its order, with each row's place in it from 1 on.

        Files lie in the order of their names and rows in that of their index, so a row's place is its
        index and the number of rows in earlier files: nothing is sorted again, and all that any one
        task sees of the whole is a row per file.
        """
        rows = self.read(layer, table)
        placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
        earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        sizes = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
        starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
        return placed.join(starts, "_file").select(*rows.columns, (F.col("_start") + F.col("_index") + 1).alias(into))

    def size(self, layer: str, table: str) -> int:
        """Bytes of the newest version's files."""
        fs, base = self._fs(), self._table(layer, table)
        folders = self.version(layer, table).parts.values()
        return sum(fs.getContentSummary(self._path(f"{base}/{f}")).getLength() for f in folders)

    def publish(
        self,
        df: DataFrame,
        layer: str,
        table: str,
        sort_by: Sequence[str | Column] = (),
        count_if: Column | None = None,
        facts: dict | None = None,
        files: int | None = None,
        bloom: Sequence[str] = (),
        file_rows: int | None = None,
        bucket_by: str | None = None,
    ) -> None:
        """Write a new version with the frame's own schema, then drop versions beyond the
        newest ``keep_versions``. ``sort_by`` range-partitions and sorts the rows, so the
        statistics of files and row groups let readers skip by those columns; ``files`` says into how
        many ranges (by default as many as the session shuffles into), and the columns of ``bloom`` get
        bloom filters for ``file_rows`` values each (by default of parquet's largest size, a megabyte, however
        few rows a file has). ``bucket_by`` writes a file per bucket of that column, as many as the session
        shuffles into: a later join or grouping by it then shuffles the other side only. Rows are counted as they are written, those that ``count_if`` holds for."""
        if sort_by:
            ranges = [files] if files else []
            df = df.repartitionByRange(*ranges, *sort_by).sortWithinPartitions(*sort_by)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if bucket_by:
            df = df.repartition(buckets, bucket_by)
        seen = Observation()
        counted = df.observe(seen, _count(count_if).alias(WHOLE))
        number, folder = self._start(layer, table)
        target, facts = f"{self._table(layer, table)}/{folder}", dict(facts or {})
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
        if file_rows:
            blooms |= {f"parquet.bloom.filter.expected.ndv#{c}": str(file_rows) for c in bloom}
        writer = counted.write.mode("errorifexists").options(**CODEC, **blooms)
        if bucket_by:
            writer.format("parquet").bucketBy(buckets, bucket_by).sortBy(bucket_by).option("path", target).saveAsTable(_entry(target))
            facts["buckets"] = [bucket_by, buckets]
        else:
            writer.parquet(target)
        self._commit(layer, table, number, Version(df.schema.jsonValue(), {WHOLE: folder}, seen.get, facts))

    def publish_parts(
        self,
        df: DataFrame,
        layer: str,
        table: str,
        names: Iterable[str],
        count_if: Column | None = None,
        facts: dict | None = None,
        replace: bool = False,
    ) -> None:
        """Write the named parts anew from ``df``, which says in ``PART`` where a row belongs; all other
        parts stay as they are (``replace``: none do). Facts are added to those of the last version.

        Parts that are too large for a task are split and small ones share one: Spark's rebalancing.
        """
        names = list(names)
        base = self.version(layer, table) if not replace and self.exists(layer, table) else None
        rows = df.drop(PART)
        schema = rows.schema.jsonValue()
        if base and rows.dtypes != [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(base.schema)]:
            raise ValueError(f"{layer}.{table} has other columns than the parts written before")
        number, folder = self._start(layer, table)
        parts = {} if base is None else {n: f for n, f in base.parts.items() if n not in names}
        counts = {} if base is None else {n: c for n, c in base.rows.items() if n in parts}
        if names:
            seen = Observation()
            per_part = [_count(F.col(PART).eqNullSafe(n) & (F.lit(True) if count_if is None else count_if)).alias(n) for n in names]
            counted = df.withColumn(PART, F.col(PART).cast("string")).observe(seen, *per_part)
            target = f"{self._table(layer, table)}/{folder}"
            counted.hint("rebalance", PART).write.mode("errorifexists").options(**CODEC).partitionBy(PART).parquet(target)
            found = {n.split("=", 1)[1]: f"{folder}/{n}" for n in self._names(target) if n.startswith(f"{PART}=")}
            if unknown := set(found) - set(names):
                raise ValueError(f"rows of parts that were not named: {sorted(unknown)}")
            parts |= found
            if found:  # else there was nothing to observe
                counts |= {n: c for n, c in seen.get.items() if n in found}
        self._commit(layer, table, number, Version(schema, parts, counts, {**(base.facts if base else {}), **(facts or {})}))

    def _start(self, layer: str, table: str) -> tuple[int, str]:
        attempts = self._attempts(layer, table)
        number = attempts[-1] + 1 if attempts else 1
        return number, f"v{number:08d}/data"

    def _commit(self, layer: str, table: str, number: int, version: Version) -> None:
        out = self._fs().create(self._marker(layer, table, number), False)
        try:
            out.write(bytearray(json.dumps(asdict(version)).encode()))
        finally:
            out.close()
        self._retire(layer, table)

    def _retire(self, layer: str, table: str) -> None:
        """Delete versions beyond those kept, but for the parts that a kept version still lists."""
        base, fs = self._table(layer, table), self._fs()
        kept = self.versions(layer, table)[-self.keep_versions :]
        used = {folder for v in kept for folder in self.version(layer, table, v).parts.values()}
        for number in self._attempts(layer, table):
            if number in kept:
                continue
            own = f"v{number:08d}"
            if not any(folder.startswith(f"{own}/") for folder in used):
                self.spark.sql(f"DROP TABLE IF EXISTS {_entry(f'{base}/{own}/data')}")
                fs.delete(self._path(f"{base}/{own}"), True)
                continue
            fs.delete(self._marker(layer, table, number), False)
            for name in self._names(f"{base}/{own}/data"):
                if f"{own}/data/{name}" not in used:
                    fs.delete(self._path(f"{base}/{own}/data/{name}"), True)


def _entry(path: str) -> str:
    """Catalog name of a bucketed part."""
    return f"lake_{hashlib.md5(path.encode()).hexdigest()}"


def _count(condition: Column | None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)
