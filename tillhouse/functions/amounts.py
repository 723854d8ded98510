from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.schemas import LINE, TOTAL


def line_amount(quantity: Column, unit_price: Column) -> Column:
    return F.round(quantity * unit_price, 2).cast(LINE)


def total(column: Column | str) -> Column:
    """Exact decimal sum."""
    return F.sum(column).cast(TOTAL)


def units(column: Column | str) -> Column:
    """Sum of whole numbers."""
    return F.sum(column).cast("bigint")


def zero_if_missing(df: DataFrame, name: str) -> Column:
    """The column, with zero of its own type where it is null."""
    return F.coalesce(F.col(name), F.lit(0).cast(df.schema[name].dataType))
