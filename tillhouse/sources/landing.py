"""Full-refresh extraction, and the typed bronze copy of what it landed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.functions import moment
from tillhouse.schemas import SOURCES, primary_key, source_schema
from tillhouse.sources.lake import Lake

LANDING = "ingestion"


def parquet_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet scan; with a schema no footer is read to infer one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def jdbc_table(
    spark: SparkSession,
    url: str,
    relation: str,
    key: str | None = None,
    partitions: int = 16,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A database table, read in key ranges when it has a numeric key.

    Only the two bounds of the key reach the driver.
    """

    def reader():
        # Options stay on a reader, and Spark refuses "query" beside "dbtable": one for each.
        return spark.read.format("jdbc").option("url", url).options(**(options or {}))

    if key is None:
        return reader().option("dbtable", relation).load()
    bounds = reader().option(
        "query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {relation}"
    ).load().first()
    if bounds.low is None:
        return reader().option("dbtable", relation).load()
    return (
        reader()
        .option("dbtable", relation)
        .option("partitionColumn", key)
        .option("lowerBound", bounds.low)
        .option("upperBound", bounds.high)
        .option("numPartitions", partitions)
        .load()
    )


def ingest(lake: Lake, table: str, extracted: DataFrame) -> None:
    """Replace the landed copy. An empty extract replaces it too, so rows deleted at the
    source are not served for ever."""
    lake.publish(extracted, LANDING, table)


def bronze_copy(
    landed: DataFrame, table: str, loaded_at: datetime | str, wide_keys: bool = False
) -> DataFrame:
    """Landed rows with the source's column types restored and one load time per batch.

    Columns the schema does not know are kept.
    """
    types = {f.name: F.col(f.name).cast(f.dataType) for f in source_schema(table, wide_keys)}
    return landed.withColumns(types).withColumn("_ingested_at", moment(loaded_at))


def jdbc_sources(
    spark: SparkSession,
    url: str,
    schema: str,
    partitions: int = 16,
    options: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Every source table of a database, tables with a numeric key read in ranges of it."""
    return {
        table: jdbc_table(
            spark,
            url,
            f"{schema}.{table}",
            key if (key := primary_key(table)).endswith("_id") else None,
            partitions,
            options,
        )
        for table in SOURCES
    }


def parquet_sources(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every source table of a folder with one parquet file or directory per table."""
    return {t: parquet_table(spark, f"{root.rstrip('/')}/{t}.parquet") for t in SOURCES}
