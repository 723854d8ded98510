"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace


def components(work: Workspace, links: DataFrame, name: str = "components") -> DataFrame:
    """``id`` and ``component`` (the smallest id it reaches) for every id of ``links`` (``a``, ``b``).

    Alternating stars: a round first links every node's larger neighbours to the smallest id
    among the node and its neighbours (large star), then its smaller neighbours and itself to the
    smallest of these (small star). Both keep what is connected and never add links. Rounds go on
    until every component is a star around its smallest id; their number grows with the logarithm of a
    chain's length, in whatever order its ids lie. The smallest ids are joined to the links as
    plain tables, which lets adaptive execution split a hub. Every step is a written table.
    """
    links = links.filter("a <> b")
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = work.save(down, f"{name}-0")
    turn = 0
    while not _stars(down):
        turn += 1
        # Large star: over both directions of each link.
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        low = work.save(low, f"{name}-large{turn}")
        raised = both.join(low, F.col("a") == F.col("id")).filter("b > a")
        large = work.save(
            raised.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), f"{name}-mid{turn}"
        )
        # Small star: over the links from the larger to the smaller id.
        low = large.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
        low = work.save(low, f"{name}-small{turn}")
        lowered = large.join(low, F.col("a") == F.col("id")).filter("b > low")
        small = lowered.select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = work.save(small.unionByName(low.select(F.col("id").alias("a"), F.col("low").alias("b"))).distinct(), f"{name}-{turn}")
        for step in (f"large{turn}", f"mid{turn}", f"small{turn}", turn - 1):
            work.drop(f"{name}-{step}")
    centres = down.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return down.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(centres)


def _stars(down: DataFrame) -> bool:
    """Whether each larger id has one link and no smaller id is itself the larger of a link."""
    ends = down.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(down.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter("out > 1 OR (out > 0 AND into > 0)").isEmpty()
