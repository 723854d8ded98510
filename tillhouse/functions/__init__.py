"""Column expressions shared by the operators. All are built-in Spark functions."""

from tillhouse.functions.amounts import line_amount, total, units, zero_if_missing
from tillhouse.functions.dates import calendar_columns, day_of, moment
from tillhouse.functions.keys import version_key
from tillhouse.functions.text import strip

__all__ = [
    "calendar_columns",
    "day_of",
    "line_amount",
    "moment",
    "strip",
    "total",
    "units",
    "version_key",
    "zero_if_missing",
]
