"""Copies on rows without an id or with a repeated one."""

from tillhouse.llm.exact_dedup import drop_copies


def test_drop_copies_tells_rows_apart_by_id_and_text(spark):
    rows = [
        (None, "copy"), (1, "copy"), (None, "only here"), (2, "copy"), (2, "own text"),
        (3, "twice"), (3, "twice"), (None, "no id"), (None, "no  id"), (4, None), (5, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    want = [(1, "copy"), (None, "only here"), (2, "own text"), (3, "twice"), (None, "no  id"), (4, None)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
