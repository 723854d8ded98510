"""Running totals that never put an unbounded group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.operators.skew import HOT_ROWS
from tillhouse.schemas import TOTAL

# Ids per block of a hot group. Ids are unique, so a block has at most this many rows.
BLOCK_BITS = 16
# Groups are counted in this many cells of their hash: a cell's rows bound those of each of its groups.
CELLS = 1 << 16


def running_total(
    df: DataFrame,
    group: str,
    day: str,
    row_id: str,
    value: str,
    into: str,
    block_bits: int = BLOCK_BITS,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to this one, by day and then id.

    ``row_id`` must be a unique whole number and ``group`` not null. As in SQL, the total is null until
    the first amount. Groups of up to ``hot_rows`` rows are summed by one window over the group, which
    shuffles nothing when the rows already lie by group. Larger ones, if any, are summed in bounded parts
    (see ``_in_blocks``). Both sum exactly, in the same order, so a group's size never decides the answer.
    Rows are counted in ``counted``, any frame that holds each group at least as often as ``df`` does: if
    ``df`` is dear to compute, what it is made from saves computing it twice.
    """
    cell = F.pmod(F.xxhash64(group), F.lit(CELLS)).alias("_cell")
    counted = df if counted is None else counted
    cells = counted.groupBy(cell).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).select("_cell")
    # At most CELLS rows of one number each, whatever the input.
    hot = F.broadcast(cells)
    marked = df.select("*", cell)
    few = marked.join(hot, "_cell", "left_anti").select(*df.columns)
    many = marked.join(hot, "_cell", "left_semi").select(*df.columns)
    so_far = Window.partitionBy(group).orderBy(_day(day), row_id).rowsBetween(Window.unboundedPreceding, 0)
    plain = few.select("*", F.sum(value).over(so_far).cast(TOTAL).alias(into))
    return plain.unionByName(_in_blocks(many, group, day, row_id, value, into, block_bits))


def _day(day: str) -> Column:
    """Never null, so that it can be joined on."""
    return F.coalesce(F.unix_date(day), F.lit(-(2**31)))


def _in_blocks(
    df: DataFrame, group: str, day: str, row_id: str, value: str, into: str, block_bits: int
) -> DataFrame:
    """The running total of groups of any size. Three levels, each bounded: days of a group, blocks of a
    day, rows of a block."""
    columns = df.columns
    earlier = (Window.unboundedPreceding, -1)
    keyed = df.withColumns(
        {
            "_day": _day(day),
            "_block": F.coalesce(F.shiftright(row_id, block_bits), F.lit(-(2**31))),
        }
    )

    blocks = keyed.groupBy(group, "_day", "_block").agg(F.sum(value).alias("_sum"))
    days = blocks.groupBy(group, "_day").agg(F.sum("_sum").alias("_sum"))
    by_day = Window.partitionBy(group).orderBy("_day").rowsBetween(*earlier)
    by_block = Window.partitionBy(group, "_day").orderBy("_block").rowsBetween(*earlier)
    days = days.select(group, "_day", F.sum("_sum").over(by_day).alias("_before_day"))
    blocks = blocks.select(
        group, "_day", "_block", F.sum("_sum").over(by_block).alias("_before_block")
    )
    starts = blocks.join(days, [group, "_day"])

    zero = F.lit(0).cast(TOTAL)
    inside = Window.partitionBy(group, "_day", "_block").orderBy(row_id)
    own = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    parts = [F.col("_before_day"), F.col("_before_block"), own]
    summed = reduce(lambda a, b: a + b, [F.coalesce(x, zero) for x in parts])
    running = F.when(F.coalesce(*[x.cast(TOTAL) for x in parts]).isNotNull(), summed)
    return keyed.join(starts, [group, "_day", "_block"]).select(
        *columns, running.cast(TOTAL).alias(into)
    )
