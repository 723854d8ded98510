"""Heap k-means against Lloyd's rounds in whole numbers."""

import hashlib
import math
import random

from tillhouse.llm.heap_kmeans import heap_kmeans, integer_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance int, vector string"


def plain(rows, k=16, rounds=3, size=64):
    kept = []
    for row in rows:
        v = row[1]
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((row[0], [math.floor(64 * x) for x in v]))
    name = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((apart(v, c), i) for i, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(centres)):
            members = [v for (_, v), (_, i) in zip(kept, own, strict=True) if i == c]
            if members:
                centres[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    own = assign()
    sums = [sum(d for d, i in own if i == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((v, c, d, sums[c], sum(sums), digest[c]) for (v, _), (d, c) in zip(kept, own, strict=True)), key=str)


def vectors(n, size=64, spread=0.3, seed=5):
    rng = random.Random(seed)
    hubs = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(9)]
    # Sixty-fourths: what Spark holds as float is what the plain version sees.
    near = lambda hub: [round((x + rng.gauss(0, spread)) * 256) / 256 for x in hub]
    return [(i, near(rng.choice(hubs)), 1, "x", 2, "y") for i in range(n)]


def awkward():
    one = [0.5] * 64
    return [
        (None, one, 1, "x", 2, "y"), (900, None, None, "x", 2, "y"), (901, [], 1, "x", 2, "y"), (902, one[:63], 1, "x", 2, "y"),
        (903, [*one[:63], None], 1, "x", 2, "y"), (904, [*one[:63], float("nan")], 1, "x", 2, "y"),
        (905, [*one[:63], float("inf")], 1, "x", 2, "y"), (906, [0.0] * 64, 1, "x", 2, "y"), (907, [-0.01] * 64, 1, "x", 2, "y"),
        (3, one, 1, "x", 2, "y"), (3, one, 1, "x", 2, "y"),
    ]


def test_clusters_equal_plain_rounds(spark):
    rows = vectors(700) + awkward()
    log = []
    got = heap_kmeans(spark.createDataFrame(rows, SCHEMA).repartition(3), log=log)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_well_separated_vectors_are_not_compared_again(spark):
    rows = vectors(2000, spread=0.01)
    log = []
    got = heap_kmeans(spark.createDataFrame(rows, SCHEMA), log=log, rounds=6)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, rounds=6)
    assert log[0] < len(rows)


def test_ties_copies_few_vectors_and_none(spark):
    same = [(i, [1.0] * 64, 1, "x", 2, "y") for i in range(50)]
    for rows in (same, same[:1], vectors(5), awkward()[1:6]):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert sorted((tuple(r) for r in heap_kmeans(docs).collect()), key=str) == plain(rows)


def test_other_sizes_and_doubles(spark):
    rows = [(i, [float(i % 7), float(i // 7)]) for i in range(80)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = heap_kmeans(docs, clusters=4, rounds=5, size=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, k=4, rounds=5, size=2)


def test_components_beyond_long_distances_are_left_out(spark):
    docs = spark.createDataFrame([(1, [1e30] * 64), (2, [2.0**20] * 64)], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in integer_vectors(docs).collect()] == [2]
