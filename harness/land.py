"""Event files as a connector lands them: named by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillhouse.session import shared_dir


def land(events: DataFrame, folder: str, offset: int) -> None:
    """Write events as files of a topic partition, the first of them named by ``offset`` (padded), the
    others by the numbers after it."""
    spark = events.sparkSession
    written = f"{shared_dir(spark, 'landed')}/files"
    events.write.parquet(written)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    files = sorted(s.getPath().getName() for s in fs.listStatus(path(written)) if s.getPath().getName().endswith(".parquet"))
    for number, name in enumerate(files):
        target = f"{folder.rstrip('/')}/{offset + number:020d}.parquet"
        if not fs.rename(path(f"{written}/{name}"), path(target)):
            raise OSError(f"could not land {target}")
