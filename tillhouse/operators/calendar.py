"""Full calendar between the first and the last year of a set of dates."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.functions import calendar_columns, moment


def full_calendar(dates: list[DataFrame], run_ts: datetime | str) -> DataFrame:
    """Every day of every year that has a date; the year of the run when there is none.

    Each input is a frame of one date column. It is reduced to its own bounds before the
    union, so only one row per input travels.
    """
    bounds = reduce(
        DataFrame.unionByName,
        [
            df.select(F.col(df.columns[0]).alias("_d")).agg(
                F.min("_d").alias("_low"), F.max("_d").alias("_high")
            )
            for df in dates
        ],
    ).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))

    def year(column: str) -> Column:
        return F.coalesce(F.year(column), F.year(moment(run_ts)))

    def day(y: Column, month: int, of_month: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(of_month))

    days = bounds.select(
        F.explode(F.sequence(day(year("_low"), 1, 1), day(year("_high"), 12, 31))).alias("date_key")
    )
    return days.select(
        "date_key",
        *[c.alias(name) for name, c in calendar_columns(F.col("date_key")).items()],
    )
