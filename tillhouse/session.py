"""Sessions, and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# What the pipeline relies on. AQE turns a shuffled join into a broadcast one when the
# measured side is small, splits the partitions of hot join keys, and drops branches whose
# input turned out to be empty.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Compressed input for each shuffle partition.
PARTITION_BYTES = 64 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session the cluster already made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES) -> int:
    """Shuffle into as many partitions as the files below a folder fill, never fewer than the session
    was set to. Adaptive execution merges those that turn out small; it does not add any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tillhouse")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Without that setting only a local session may fall back to a temporary folder: on a
    cluster such a folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tillhouse-")
    return f"{base.rstrip('/')}/tillhouse/{purpose}-{uuid.uuid4().hex}"
