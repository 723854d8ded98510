"""One query per operator over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.llm.byte_bpe import read_ranks, round_trip
from tillhouse.llm.embedding_dedup import embedding_dedup
from tillhouse.llm.exact_dedup import exact_dedup
from tillhouse.llm.fingerprints import compare_with_edits
from tillhouse.llm.heap_kmeans import heap_kmeans
from tillhouse.llm.jaccard_join import jaccard_join
from tillhouse.llm.license_scan import scan_licenses
from tillhouse.llm.manifest import verify_tampered
from tillhouse.llm.mixing import mix
from tillhouse.llm.quality import score, train
from tillhouse.llm.sharding import shard_documents
from tillhouse.llm.substring_dedup import substring_dedup
from tillhouse.llm.url_filter import filter_urls

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def token_digests(docs: DataFrame) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(RANKS))
    coded = round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return token_digests(_table(spark, directory, "documents"))


def op2_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return shard_documents(_table(spark, directory, "documents"))


def op3_mixing(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mix(_table(spark, directory, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard_join(_table(spark, directory, "documents"))


def op5_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    judged = exact_dedup(_table(spark, directory, "documents"))
    return judged.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return scan_licenses(_table(spark, directory, "documents"))


def op7_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    cleaned = substring_dedup(_table(spark, directory, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_embedding_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return embedding_dedup(_table(spark, directory, "embeddings"))


def op9_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    return score(docs, train(docs, _table(spark, directory, "labels")))


def op10_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    judged = filter_urls(_table(spark, directory, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return compare_with_edits(_table(spark, directory, "documents"))


def op12_heap_kmeans(spark: SparkSession, directory: str) -> DataFrame:
    return heap_kmeans(_table(spark, directory, "embeddings"))


def op13_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return verify_tampered(_table(spark, directory, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_sharding,
        op3_mixing,
        op4_jaccard_join,
        op5_exact_dedup,
        op6_license_scan,
        op7_substring_dedup,
        op8_embedding_dedup,
        op9_quality,
        op10_url_filter,
        op11_fingerprints,
        op12_heap_kmeans,
        op13_manifest,
    )
}
