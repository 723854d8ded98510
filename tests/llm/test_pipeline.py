"""The pipeline: its stages take effect one after the other."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_operator_and_the_pipeline_are_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"]


def near_first(rows):
    """Ids that stay when one document of each component of near duplicates does: all pairs compared."""
    sets = {}
    for r in rows:
        words = "".join(c.lower() if c.isascii() else c for c in r.text).encode().split()
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        sets[r.doc_id] = set(runs)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    return {i for i in ids if top(i) == i}


def mix_targets(sizes):
    """Words wanted of each source: shares by weight, none above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    full, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**full, **{s: level * weight[s] for s in open_}}
        for s in over:
            full[s] = 3 * sizes[s]
            left -= 3 * sizes[s]


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    frame, tables = docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, DATA)
        assert frame.columns == docs.columns
        rows = frame.collect()
        kept.append({r.doc_id for r in rows})
        tables.append(rows)
        assert kept[-1] <= kept[-2]
        frame = spark.createDataFrame(rows, docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i in kept[0] if labels.get(i) == 1]
    assert sum(i in kept[1] for i in good) >= 0.95 * len(good)
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    first = {}
    for i in sorted(kept[1]):
        first.setdefault(texts[i], i)
    assert kept[2] == set(first.values())
    assert kept[3] == near_first(tables[1])
    words = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in tables[2]}}
    longest = {r.source: max(len(x.text.split()) for x in tables[2] if x.source == r.source) for r in tables[2]}
    taken = words(tables[3])
    for source, wanted in mix_targets(words(tables[2])).items():
        # Within a document of the target, and within the blocks that are seats of the mix.
        assert abs(taken[source] - wanted) <= longest[source] + 0.05 * wanted, source
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() == frame.count()
    joined = out.join(docs, "doc_id").filter(F.sha2("text", 256) != F.col("decoded_sha256"))
    assert joined.isEmpty()
