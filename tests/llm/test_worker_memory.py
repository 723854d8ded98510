"""What Python workers are sent at a time, and what they keep when a task has ended."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from tillhouse.llm import byte_bpe
from tillhouse.llm.byte_bpe import Coder, read_ranks, round_trip
from tillhouse.llm.queries import RANKS
from tillhouse.llm.workspace import BATCH_SETTING, importable


def test_workers_are_sent_small_batches_of_long_rows(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 64).alias("text"))
    given = spark.conf.get(BATCH_SETTING)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    spark.conf.unset(BATCH_SETTING)
    try:
        importable(spark)
        sent = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
        assert sum(sent) > 12_000_000 and max(sent) < 5_000_000
        spark.conf.set(BATCH_SETTING, "1m")  # the session's own bound stays
        importable(spark)
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(BATCH_SETTING, given)


def test_a_task_ends_its_database_and_keeps_its_pieces():
    data, names = read_ranks(public_tokenizers.path(RANKS)), ["doc_id", "text"]
    texts = ["unforgettably so", None, "", "ab cd\n ef"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], names)
    encoder, decoder = byte_bpe._encoder(data, public_tokenizers.PATTERN), byte_bpe._decoder(data)
    run = byte_bpe._task(data, lambda batches: decoder(encoder(batches)))
    for _ in range(2):  # a second task of the same worker
        rows = [r for out in run(iter([batch])) for r in out.to_pylist()]
        assert [r["decoded"] for r in rows] == [(t or "").encode() for t in texts]
        assert Coder.of(data)._db is None and Coder.of(data).seen


def test_round_trip_over_several_tasks(spark):
    data = read_ranks(public_tokenizers.path(RANKS))
    docs = spark.range(0, 60, 1, 6).select("id", F.concat(F.lit("naïve text "), "id").alias("text"))
    out = round_trip(docs, data, public_tokenizers.PATTERN, doc_id="id").join(docs, F.col("doc_id") == F.col("id"))
    assert out.filter(F.col("decoded") == F.encode("text", "UTF-8")).count() == 60
