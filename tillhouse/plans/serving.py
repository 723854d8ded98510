"""Published copies of gold and mart tables, sorted for the queries they serve.

A served table has a file per ``FILE_BYTES`` of its lake table, or per ``FILE_ROWS`` rows if those are more,
each a range of the sort key, and bloom filters on the columns that single rows are looked up by: a point
read skips all row groups but those that may hold its rows. One task sorts one file, and the rows of a mart
take far more memory than their compressed bytes, so bytes alone would not bound it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.plans.run import together
from tillhouse.sources.lake import Lake

SERVED_LAYER = "marts"
RANKED_LAYER = "ranked"
FILE_BYTES = 128 << 20
FILE_ROWS = 1 << 20
# Files that a caller's smaller ``file_bytes`` may ask for. Each is a task and a block of every map task, so
# without a bound small files cost time with the square of the table.
MOST_SMALL_FILES = 128

# --- Fixed values: served table -> layer it comes from and its sort key ---------------
SERVED = {
    "dim_customer": ("gold", ("customer_key",)),
    "dim_product": ("gold", ("product_key",)),
    "dim_store": ("gold", ("store_key",)),
    "dim_date": ("gold", ("date_key",)),
    "fact_sales": ("gold", ("date_key", "item_key")),
    "fact_refunds": ("gold", ("date_key", "refund_key")),
    "daily_sales_mart": ("mart", ("date_key", "store_name")),
    "product_sales_mart": ("mart", ("category", "product_name")),
    "customer_sales_mart": ("mart", ("customer_key",)),
}
# Marts with an order by a measure, highest first: measure and what decides between equals.
RANKED = {
    "product_sales_mart": ("revenue", ("category", "product_name")),
    "customer_sales_mart": ("total_spent", ("customer_key",)),
}
# Columns that rows of a served table are looked up by, beside the sort key.
LOOKED_UP = {"dim_customer": ("customer_id",), "fact_sales": ("item_key", "customer_key"), "fact_refunds": ("refund_key",)}
# --- End of fixed values ---------------------------------------------------------------


def serve_table(
    lake: Lake,
    table: str,
    served: Lake | None = None,
    file_bytes: int = FILE_BYTES,
    file_rows: int = FILE_ROWS,
) -> None:
    """Publish one table for readers. They see the previous copy until the new one is
    whole, and keep it when the build fails or the lake is away. ``file_bytes`` below ``FILE_BYTES`` is
    kept to up to ``MOST_SMALL_FILES`` files; a larger table has larger files, ``FILE_BYTES`` at most."""
    layer, sort_key = SERVED[table]
    rows = lake.read(layer, table)
    count = lake.version(layer, table).row_count
    size = lake.size(layer, table)
    small = min(MOST_SMALL_FILES, -(-size // file_bytes))
    files = max(1, -(-count // file_rows), -(-size // max(file_bytes, FILE_BYTES)), small)
    target, bloom = served or lake, LOOKED_UP.get(table, ())
    target.publish(
        rows, SERVED_LAYER, table, sort_key, files=files, bloom=bloom, file_rows=max(1, -(-count // files))
    )


def rank_table(lake: Lake, table: str) -> DataFrame:
    """A mart in the order of its measure, highest first, with ``rank``: 1, 2, ... without ties.

    The order is published, so a reader takes any range of ranks, or all in order, without sorting.
    """
    measure, names = RANKED[table]
    order = [F.col(measure).desc_nulls_last(), *[F.col(n).asc_nulls_first() for n in names]]
    lake.publish(lake.read("mart", table), RANKED_LAYER, table, order)
    return lake.numbered(RANKED_LAYER, table, "rank")


def serve(lake: Lake, tables: Iterable[str] = SERVED, served: Lake | None = None) -> None:
    together(partial(serve_table, lake, table, served) for table in tables)
