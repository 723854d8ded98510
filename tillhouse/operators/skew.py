"""Joins that spread hot keys.

Most joins of the pipeline need nothing from here: both inputs are plain shuffles, and
adaptive execution splits the partition of a hot key. It cannot do that when one input is
already grouped by the join key. Those joins are spread here. None of them forces a
broadcast of the table itself: Spark still broadcasts it when its size allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a task should hold. Keys with more are spread over as many slots as
# that takes, however many such keys there are.
HOT_ROWS = 100_000


def hottest(counts: DataFrame, keys: Sequence[str], count: str, hot_rows: int) -> DataFrame:
    """Every key with more than ``hot_rows`` rows, and ``_slots``: how many tasks share it."""
    return counts.filter(F.col(count) > hot_rows).select(
        *keys, F.ceil(F.col(count) / hot_rows).cast("int").alias("_slots")
    )


def spread_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Join ``many`` rows per key with ``one`` row per key, sharing hot keys among tasks.

    Rows of a hot key get one of its slots from their own content, so a retried task repeats
    the choice; the single row on the other side is copied to every slot. Rows with a null key
    match nothing and are spread as well. Spark broadcasts the hot keys when they are few.
    """
    no_key = reduce(lambda a, b: a | b, [many[c].isNull() for c in on])
    hashed = F.xxhash64(*[many[c] for c in many.columns])
    slots = F.when(no_key, F.lit(1 << 20)).otherwise(F.coalesce("_slots", F.lit(1)))
    left = many.join(hot, list(on), "left").withColumn("_slot", F.pmod(hashed, slots).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1))
    right = one.join(hot, list(on), "left").withColumn("_slot", copies)
    joined = left.drop("_slots").join(right.drop("_slots"), [*on, "_slot"], how)
    return joined.drop("_slot")
