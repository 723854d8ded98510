"""Point-in-time join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.schemas import MOMENT


def valid_on(
    days: DataFrame, versions: DataFrame, id_column: str, date_column: str, version_key: str
) -> DataFrame:
    """``id_column``, ``date_column`` and the version valid at that date's midnight, for distinct
    pairs of id and date.

    Versions and days lie in one stream per id, in order of time, a version before a day that it
    starts on; the last version seen is carried forward and counts while it is valid. An id's
    stream has a row per version and day and no more, however many facts a day has: no pair of a
    day and a version is ever formed.
    """
    start = F.struct(F.col(version_key).alias("key"), "valid_to")
    marks = versions.select(
        F.col(id_column), F.col("valid_from").alias("_at"), start.alias("_start"), F.lit(None).cast("date").alias("_day")
    )
    asked = days.select(
        F.col(id_column), F.col(date_column).cast(MOMENT).alias("_at"),
        F.lit(None).cast(marks.schema["_start"].dataType).alias("_start"), F.col(date_column).alias("_day"),
    )
    # Versions first: a null day sorts before any other.
    so_far = Window.partitionBy(id_column).orderBy("_at", "_day").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        marks.unionByName(asked)
        .filter(F.col(id_column).isNotNull() & F.col("_at").isNotNull())
        .withColumn("_last", F.last("_start", ignorenulls=True).over(so_far))
    )
    return carried.filter(F.col("_day").isNotNull() & (F.col("_at") < F.col("_last.valid_to"))).select(
        id_column, F.col("_day").alias(date_column), F.col("_last.key").alias(version_key)
    )


def as_of_version(
    facts: DataFrame,
    versions: DataFrame,
    id_column: str,
    date_column: str,
    version_key: str = "customer_key",
) -> DataFrame:
    """Add the key of the version valid at midnight of the fact's date; a fact without one is dropped.

    Facts collapse to their distinct ids and dates inside the map tasks, these find their versions (see
    ``valid_on``), and the facts then join them by equality. A hot customer is cut into its days, and
    the days of many facts are split by adaptive execution like any other hot key.
    """
    pair = [id_column, date_column]
    found = valid_on(facts.select(*pair).distinct(), versions, id_column, date_column, version_key)
    columns = [c for c in facts.columns if c not in pair]
    return facts.join(found, pair).select(*pair, *columns, version_key).select(*facts.columns, version_key)
