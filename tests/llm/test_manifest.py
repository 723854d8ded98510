"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib

import pytest

from tillhouse.llm import manifest
from tillhouse.llm.manifest import ARITY, coordinates, derive, fold, merkle_manifest, siblings, verify_tampered

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, tree int, pos int, part string, level int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def tree(level):
    """Every level of a tree, leaves first."""
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        levels.append(level)
    return levels


def proof(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def refold(value, path):
    for left, right in path:
        value = h(*left, value, *right)
    return value


def order(row):
    return (row[0] is not None, row[0] or 0, leaf(row))


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=order) for s in sources]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for n, group in enumerate(groups):
        for at, row in enumerate(group):
            path = proof(trees[n], at) + proof(top, n)
            seen = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                seen = (*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4]))
            folded = refold(leaf(seen), path)
            flat = "".join(d for left, right in path for d in (*left, *right))
            out.append((row[0], leaf(row), trees[n][-1][0], top[-1][0], h(flat), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows(n):
    rng = random.Random(n)
    names = [None, "", "a", "é", "hot", "hot", "hot", "zz", *[f"s{i}" for i in range(20)]]
    out = [
        (i, rng.choice(names), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "Text É Ab", f"t{i}"]), 1, 2, "x", 3)
        for i in range(n)
    ]
    return out + [(None, "hot", None, None, None, 1, 2, "x", 3)] * 3 + out[:2]


@pytest.mark.parametrize(("n", "span"), [(0, 4096), (1, 4096), (40, 16), (700, 64)])
def test_manifest_equals_the_plain_version(spark, monkeypatch, n, span):
    monkeypatch.setattr(manifest, "SPAN", span)
    data = rows(n)
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = verify_tampered(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(data)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert verify_tampered(docs).collect() == []
    assert merkle_manifest(docs).root is None


def test_proofs_of_a_few_leaves_fetch_a_few_nodes(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "'en' AS lang", "1 AS n_chars", "string(id) AS text"
    )
    made = merkle_manifest(docs)
    wanted = made.leaves.filter("doc_id % 500 = 0")
    proofs = made.prove(wanted).collect()
    assert sorted(r.doc_id for r in proofs) == [0, 500, 1000, 1500, 2000, 2500]
    assert {r.folded_root for r in proofs} == {made.root}
    assert made.requests(wanted).count() < 600


@pytest.mark.parametrize("width", [1, 2, 16, 17, 255, 256, 257, 5000])
def test_multiproof_is_enough_and_least(width):
    leaves = [h(str(i)) for i in range(width)]
    levels = tree(leaves)
    rng = random.Random(width)
    asked = sorted(rng.sample(range(width), min(width, 7)))
    need = coordinates(asked, width)
    assert len(set(need)) == len(need)
    nodes = {(level, p): levels[level][p] for level, p in need}
    nodes.update(((0, p), leaves[p]) for p in asked)
    assert derive(nodes, asked, width) == levels[-1][0]
    for p in asked:
        path = siblings(nodes, p, width)
        assert path == proof(levels, p) and fold(leaves[p], path) == levels[-1][0]
    # None can be left out, and none follows from the others.
    used = {(level, q) for p in asked for level, q in _siblings_of(p, width)}
    given = {(level, a) for a in asked for level, a in _path_of(a, width)}
    assert set(need) == used - given


def _path_of(p, width):
    out, level = [], 0
    while True:
        out.append((level, p))
        if width == 1:
            return out
        p, width, level = p // ARITY, -(-width // ARITY), level + 1


def _siblings_of(p, width):
    out, level = [], 0
    while width > 1:
        run = p // ARITY * ARITY
        out += [(level, q) for q in range(run, min(run + ARITY, width)) if q != p]
        p, width, level = p // ARITY, -(-width // ARITY), level + 1
    return out
