"""The filtering stage when no label can be learned from."""

from tillhouse.llm.quality import keep_good


def test_all_documents_stay_without_a_trusted_label(spark):
    docs = spark.createDataFrame([(1, "some clean words."), (2, None)], "doc_id bigint, text string")
    for rows in ([], [(1, None), (2, None)], [(1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        assert sorted(r.doc_id for r in keep_good(docs, labels).collect()) == [1, 2]
