from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillhouse.schemas import CUSTOMER_KEY_FACTOR


def version_key(id_column: Column, version: Column) -> Column:
    """Surrogate key of one version; a rebuild gives the same keys."""
    return id_column.cast("bigint") * F.lit(CUSTOMER_KEY_FACTOR) + version
