"""Exact dedup against a persistent index of text digests.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest,
the rows that the index has already are dropped by a sort-merge anti-join that reads the
index by bucket, without shuffling it, and the rest is appended.

Texts are equal when identical after each run of ASCII white space becomes one space; a null
text counts as empty. Of equal texts of a batch the row with the smallest id stays, unless an
earlier batch has stored one: then that one stays. Null ids come after all others. Rows that
repeat an id with an equal text are the same document: both carry the same answer. Other
columns of the input are ignored. An empty batch leaves the index as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace, boxed

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), BLANKS, " ")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the SHA-256 of the normalised text as 32 bytes."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest")
    )


class DigestIndex:
    """Digests seen so far with the id that stays for each.

    ``path`` is where the files live; a later session opens the same index by path. The
    number of buckets is fixed when the index is made: choose it so that a bucket of the
    final index fits a task (32 GB of digests in 4,096 buckets are 8 MB each).
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (keep_id BIGINT, digest BINARY) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (``doc_id``, ``digest``) that are new.

        Adding a batch again changes nothing, so a job that died half way is simply rerun.
        """
        first = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        known = self.read().select("digest").hint("merge")
        new = first.join(known, "digest", "left_anti")
        # The partitioning of the buckets: each task appends to one bucket.
        new = new.select("keep_id", "digest").repartition(self.buckets, "digest")
        new.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    index: DigestIndex | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    The group size counts the equal rows of this batch. Without ``index`` a new one is made
    in the shared folder.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    if index is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = "digests_" + work.root.rsplit("-", 1)[-1]
        index = DigestIndex(spark, f"{work.root}/index", name, buckets)
    batch = work.save(digests(docs, doc_id, text), "batch")
    index.add(batch)
    sizes = batch.groupBy("digest").agg(F.count("*").alias("group_size"))
    # One row per digest on both sides. Saved, it is a plain table: adaptive execution can then
    # split the partition of a digest that a third of the batch shares.
    groups = work.save(sizes.join(index.read().hint("merge"), "digest"), "groups")
    return batch.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, all columns unchanged, whatever their names.

    Rows are told apart by id and digest, so ids may be null or repeat with other texts. Of rows
    that repeat both, the one with the smallest text stays (they may differ in white space and
    in other columns). Only the pairs that drop a row meet the documents.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    # Saved first: rows of one digest then meet their group in a join that adaptive execution can
    # split, and are counted by id and digest in a shuffle of its own.
    judged = work.save(exact_dedup(docs, doc_id, text).select("doc_id", "digest", "kept"), "judged")
    pairs = judged.groupBy("doc_id", "digest").agg(F.count("*").alias("_rows"), F.first("kept").alias("_kept"))
    marked = pairs.filter("_rows > 1 OR NOT _kept").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "_kept"
    )
    marked = work.save(marked, "marked")
    work.drop("judged")
    rows = boxed(docs, _own=F.col(doc_id), _text=F.col(text), _own_digest=F.unhex(F.sha2(normalised(text), 256)))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest"))
    # Sort-merge at every size, as the pairs may be too many to broadcast.
    single = rows.join(marked.hint("merge"), same, "left_anti").select("_row.*")
    repeated = marked.filter("_kept")
    if repeated.isEmpty():
        return single
    least = F.min_by("_row", F.struct("_text")).alias("_row")
    one = rows.join(repeated.hint("merge"), same).groupBy("_id", "_digest").agg(least).select("_row.*")
    return single.unionByName(one)
