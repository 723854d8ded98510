"""Words out of the mix against its targets."""

import random

from tillhouse.llm.mixing import mix, repeat_documents


def test_repeated_documents_meet_the_targets_at_any_block_length(spark):
    rng = random.Random(8)
    sizes = [rng.randint(1, 400) for _ in range(600)]
    rows = [(i if i % 40 else None, "w " * n, "abc"[i % 3] if i % 100 < 95 else None) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = {r.source: r.target for r in mix(docs).collect()}
    for options in ({}, {"blocks": 655}):
        out = repeat_documents(docs, **options)
        words = dict.fromkeys(targets, 0)
        for r in out.collect():
            words[r.source] += len(r.text.split())
        for source, target in targets.items():
            # The longest document, and the half block that seats are rounded by.
            assert abs(words[source] - target) <= 2 * 400, (options, source, words[source], target)
    again = sorted((r.doc_id or 0, len(r.text)) for r in repeat_documents(docs.repartition(3)).collect())
    assert again == sorted((r.doc_id or 0, len(r.text)) for r in repeat_documents(docs).collect())
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], docs.schema)
    assert {r.doc_id for r in repeat_documents(blank).collect()} == {1, 2}
