from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillhouse.schemas import MOMENT


def moment(value: datetime | str) -> Column:
    """One point in time as a constant, so a retried task sees the same value."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast(MOMENT)


def day_of(days_since_1970: Column) -> Column:
    return F.date_from_unix_date(days_since_1970.cast("int"))


def calendar_columns(day: Column) -> dict[str, Column]:
    """Date parts with English names and ISO weekdays (Monday is 1)."""
    weekday = F.weekday(day) + 1
    return {
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "day": F.dayofmonth(day),
        "day_of_week": weekday,
        "day_name": F.date_format(day, "EEEE"),
        "is_weekend": weekday >= 6,
    }
