from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\v\f"


def strip(column: Column | str) -> Column:
    """Remove white space of every kind from both ends; ``F.trim`` only removes spaces."""
    return F.btrim(column, F.lit(WHITESPACE))
