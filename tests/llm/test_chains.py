"""Components of long chains."""

import random

from tillhouse.llm.components import components
from tillhouse.llm.workspace import Workspace


def test_components_of_a_shuffled_chain(spark):
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    links = [*chain, (2001, 2000), (2001, 2001), (3000, 3000), (2002, 2001), (2001, 2000)]
    found = components(Workspace(spark, "test-chain"), spark.createDataFrame(links, "a bigint, b bigint"))
    want = {(i, 0) for i in ids} | {(i, 2000) for i in (2000, 2001, 2002)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
