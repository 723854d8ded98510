"""Translation of codes through a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.schemas import UNKNOWN


def join_lookup(many: DataFrame, lookup: DataFrame, code: str, how: str) -> DataFrame:
    """Join with a table that has one row per code, where few codes may hold most rows.

    A lookup that was just reduced to one row per code is grouped by the join key already, which would
    keep adaptive execution from splitting a hot code. Rebalancing makes it a plain table
    again: Spark then broadcasts it when its size allows and splits hot codes when it does
    not, and ``many`` is read once.
    """
    return many.join(lookup.hint("rebalance"), code, how)


def translate(
    df: DataFrame, lookup: DataFrame, code: str, name: str, default: str = UNKNOWN
) -> DataFrame:
    """Add the name of a code and keep rows whose code is unknown."""
    named = join_lookup(df, lookup.select(code, name), code, "left")
    return named.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
