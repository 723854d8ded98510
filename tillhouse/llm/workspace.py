"""Written tables that cut lineage, and exact ranks and running sums without one hot task."""

from __future__ import annotations

import contextlib
import hashlib
import math
import os
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillhouse.session import shared_dir

# Text bytes that one task handles when an operator deals documents out anew.
TASK_BYTES = 24 << 20
# Bytes of the rows that a Python worker is sent at a time. Executor and worker each hold several such
# batches outside the heap; by Spark's own bound of 64 MB a batch is 10,000 documents or pairs of texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
# Whether an execution's shuffle files go when it ends, not when the driver collects its garbage.
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables of one run in the cluster's shared folder (``spark.checkpoint.dir``).

    A saved table replaces the plan that made it, so a lost executor costs the step that was
    running and nothing before it. Tables stay until ``drop`` or until the folder is cleared. Without
    ``keep_shuffles``, the shuffle files that made a table go when it is saved.
    """

    def __init__(self, spark: SparkSession, purpose: str, keep_shuffles: bool = True):
        importable(spark)
        self.spark = spark
        self.keep_shuffles = keep_shuffles
        self.root = shared_dir(spark, purpose)
        self._entries: set[str] = set()

    def save(self, df: DataFrame, name: str, by: str | None = None, file_rows: int | None = None) -> DataFrame:
        """by: a column to make folders of. file_rows: the most rows of a file, if set."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if file_rows:
            writer = writer.option("maxRecordsPerFile", file_rows)
        with contextlib.nullcontext() if self.keep_shuffles else _brief_shuffles(self.spark):
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_buckets(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A saved table in buckets of a key, as many as the session shuffles into: joins by the key
        shuffle only their other side."""
        path, count = f"{self.root}/{name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.repartition(count, key).write.mode("overwrite").format("parquet").bucketBy(count, key)
        writer.option("compression", "zstd").option("path", path).saveAsTable(_entry(path))
        self._entries.add(name)
        return self.spark.table(_entry(path))

    def drop(self, name: str) -> None:
        if name in self._entries:
            self.spark.sql(f"DROP TABLE IF EXISTS {_entry(f'{self.root}/{name}')}")
            self._entries.remove(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _brief_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_SETTING, None)
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_SETTING)
        else:
            spark.conf.set(SHUFFLE_SETTING, before)


def _entry(path: str) -> str:
    """Catalog name of a table in buckets."""
    return f"work_{hashlib.md5(path.encode()).hexdigest()}"


def boxed(df: DataFrame, **helpers: Column) -> DataFrame:
    """The rows of a table as one struct, ``_row``, beside helper columns: whatever names its columns
    have, none clashes. ``_row.*`` gives them back."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(row, *[value.alias(name) for name, value in helpers.items()])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and send them small batches.

    On a cluster the package is installed or shipped with ``--py-files``; this serves sessions
    whose driver runs from a checkout. A bound that the session was given stays.
    """
    spark.conf.set(BATCH_SETTING, spark.conf.get(BATCH_SETTING, BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task. A worker goes on to other operators' tasks, so what the batches
    of this one took goes back to the system at its end."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def task_count(spark: SparkSession, size: int, per_task: int = TASK_BYTES) -> int:
    """Tasks for ``size`` bytes: at least the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / per_task))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n
    return int(total or 0)


def running(
    work: Workspace,
    name: str,
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: str | None = None,
    into: str = "before",
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the group (or their number).

    The rows are range-partitioned and sorted by group and order, so a group that holds a
    third of all rows spans many partitions. Each partition then numbers only its own rows;
    the totals of whole partitions (one row per group and partition) are summed before them.
    The order must be total for repeatable results.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    plain = list(df.columns)
    ranged = df.withColumns(dict(zip(keys, cols, strict=True)))
    ranged = ranged.repartitionByRange(
        int(work.spark.conf.get("spark.sql.shuffle.partitions")), *group, *keys
    ).withColumn("_part", F.spark_partition_id())
    kept = work.save(ranged, name)

    amount = F.col(value) if value else F.lit(1)
    totals = kept.groupBy(*group, "_part").agg(F.sum(amount).cast("bigint").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*keys)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(inside).cast("bigint"), F.lit(0))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_part"]]
    counted = kept.withColumn("_own", own)
    return (
        counted.alias("a")
        .join(starts.alias("b"), on)
        .select(*[F.col(f"a.{c}") for c in plain], (F.col("_own") + F.col("_start")).alias(into))
    )
