"""The pipeline's stages on tables whose columns are named like their helpers, on NULL and repeated
ids, and on no rows at all."""

import pytest
from pyspark.sql import functions as F

from tillhouse.llm.exact_dedup import drop_copies
from tillhouse.llm.jaccard_join import keep_first
from tillhouse.llm.mixing import repeat_documents
from tillhouse.llm.quality import keep_good
from tillhouse.llm.queries import token_digests

CLASHING = [
    "_n", "_time", "_id", "_size", "_name", "_copies", "_digest", "_kept", "_gone", "_row", "_own", "_text", "_from",
    "_source", "_rows", "_own_digest", "digest", "kept", "size", "target", "rank", "block", "n", "id", "a.b",
]
STAGES = [drop_copies, keep_first, repeat_documents]


def clashing(spark, rows):
    """Documents with a column of every helper's name, all telling the row they belong to."""
    docs = spark.createDataFrame(
        [(n, i, t, s) for n, (i, t, s) in enumerate(rows)], "mark int, doc_id bigint, text string, source string"
    )
    return docs.select("doc_id", "text", "source", "mark", *[F.col("mark").alias(c) for c in CLASHING]).repartition(3)


def words(seed, n):
    return " ".join(f"w{(seed * 31 + k * k) % 997}" for k in range(n))


ROWS = [
    *[(n, words(n, 60), "big") for n in range(12)],
    (20, words(1, 60), "big"),  # a copy
    (21, words(2, 59) + " changed", "small"),  # a near copy
    (None, words(30, 40), None),
    (None, words(31, 40), None),
    (None, words(1, 60), "small"),
    (3, words(32, 40), "small"),  # an id again, with another text
    (4, words(4, 60), "big"),  # a row again
    (40, None, "small"),
    (41, "", None),
]


def marks(df):
    rows = df.collect()
    for r in rows:
        assert all(r[c] == r.mark for c in CLASHING), "a column of the input was changed"
    return sorted(r.mark for r in rows)


@pytest.mark.parametrize("stage", STAGES)
def test_columns_named_like_helpers_come_out_unchanged(spark, stage):
    docs = clashing(spark, ROWS)
    out = stage(docs)
    assert out.columns == docs.columns
    assert set(marks(out)) <= set(range(len(ROWS)))


def test_what_each_stage_keeps_of_them(spark):
    docs = clashing(spark, ROWS)
    # 20 and the copy without an id go, one of the rows of 4 and of the empty ones stays.
    kept = marks(drop_copies(docs))
    assert {12, 16}.isdisjoint(kept) and len({4, 18} & set(kept)) == 1 and (19 in kept, 20 in kept) == (True, False)
    # Rows without an id stay, whatever they resemble; 20 and 21 go; an id has one component for all its rows.
    kept = marks(keep_first(docs))
    assert {14, 15, 16, 17, 3, 4, 18, 19, 20} <= set(kept) and {12, 13}.isdisjoint(kept)
    # Blank rows are neither taken nor refused.
    assert {19, 20} <= set(marks(repeat_documents(docs)))


def test_a_hidden_clash_of_the_first_and_the_last_stage(spark):
    docs = clashing(spark, ROWS)
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(12)], "doc_id bigint, quality int, toxic int")
    out = keep_good(docs, labels)
    assert out.columns == docs.columns
    marks(out)
    assert token_digests(docs).count() == len(ROWS)


@pytest.mark.parametrize("stage", STAGES)
def test_no_rows_give_no_rows(spark, stage):
    docs = clashing(spark, ROWS)
    out = stage(docs.filter("false"))
    assert out.columns == docs.columns and out.collect() == []
