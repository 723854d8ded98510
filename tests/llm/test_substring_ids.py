"""Rows without an id, in quantity."""

from tillhouse.llm.substring_dedup import substring_dedup


def test_rows_without_an_id_are_documents_of_their_own(spark):
    shared = " ".join(f"shared{i}" for i in range(30))
    own = lambda n: " ".join(f"own{n}x{i}" for i in range(25))
    rows = [(None, f"{own(n)} {shared}" if n % 3 == 0 else own(n)) for n in range(300)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    removed = sorted(r.n_removed for r in got)
    # Of a hundred rows with the passage one keeps it; no other row loses a word at the same places.
    assert removed == [0] * 201 + [30] * 99
    assert sum(shared in r.kept for r in got) == 1
