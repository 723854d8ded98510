"""A training corpus from raw documents: score, dedup twice, mix, tokenize.

Every stage works on all that the one before kept, is written as Parquet and reread. The first
four return the columns of ``documents``; the last returns a row of token digests per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillhouse.llm.exact_dedup import drop_copies
from tillhouse.llm.jaccard_join import keep_first
from tillhouse.llm.mixing import repeat_documents
from tillhouse.llm.quality import keep_good
from tillhouse.llm.queries import token_digests
from tillhouse.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeat_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row, and proof that they decode to its text."""
    return token_digests(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

# Neither the classifier nor the seeded mix can be written in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
