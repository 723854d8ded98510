"""Winnowing against a plain version, its guarantee, and awkward rows."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tillhouse.llm.fingerprints import BASE, POSITIONS, PRIME, UNIT, compare_with_edits, fingerprints

SCHEMA = "doc_id bigint, text string, block bigint, place int, copies string, _id int, _hash int"
PATTERN = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), UNIT))


def plain(text, k=5, w=6):
    """(hash, position) of every pick, window by window."""
    units = [zlib.crc32(u.encode()) for u in PATTERN.findall(text)]
    if not units:
        return []
    runs = [units] if len(units) < k else [units[i : i + k] for i in range(len(units) - k + 1)]
    hashes = []
    for run in runs:
        value = 1
        for unit in run:
            value = (value * BASE + unit) % PRIME
        hashes.append(value)
    found = {}
    for start in range(max(1, len(hashes) - w + 1)):
        spots = range(start, min(start + w, len(hashes)))
        found[min(spots, key=lambda i: (hashes[i], -i))] = True
    return [(hashes[i], i) for i in sorted(found)]


def texts():
    words = [f"w{i * i % 97}" for i in range(600)]
    return [
        None, "", " \t\n", "one", "two words", "a b c d e", "a b c d e f g", " ".join(words), " ".join(words[:300]),
        "same same same " * 30, "漢字かな交じり文の例です そして words も", "x" * 5000, "naïve café 😀 " * 20, "w\u00a0w \u3000 z",
    ]


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_the_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id here"), (3, "repeated id")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    want = sorted((str(i), len(t or ""), plain(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_chars, [tuple(p) for p in r.fingerprint]) for r in got) == want


def test_shared_passages_of_the_guaranteed_length_share_a_pick(spark):
    shared = [f"shared{i}" for i in range(10)]  # WINDOW + UNITS - 1
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(17 * i)] + shared + [f"after{i}x{j}" for j in range(9)])) for i in range(6)]
    prints = fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    first = {p.hash for p in prints[0].fingerprint}
    assert all(first & {p.hash for p in r.fingerprint} for r in prints)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_edits_against_the_plain_version(spark, block):
    rows = [(i * 3, t, 1, 2, "x", 4, 5) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in compare_with_edits(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block).collect()}
    assert len(got) == len(rows)
    for n, (i, t, *_) in enumerate(rows):
        own, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + after[:q]
        r = got[i]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{h}@{p}" for h, p in plain(own))
        assert r.edited_fingerprint == " ".join(f"{h}@{p}" for h, p in plain(edited))
        assert r.near_edited == pytest.approx(likeness(plain(own), plain(edited)))
        assert r.near_next == pytest.approx(likeness(plain(own), plain(after)))


def test_null_and_repeated_ids_one_document_and_none(spark):
    rows = [(None, "p q"), (None, "p q"), (None, "r s t"), (7, "u"), (7, "u"), (7, "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    out = compare_with_edits(docs)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["7", "7", "7", "None", "None", "None"]
    assert out.distinct().count() == 4
    one = compare_with_edits(docs.filter("text = 'r s t'")).collect()
    assert [(r.near_edited >= 0, r.near_next) for r in one] == [(True, 1.0)]
    assert compare_with_edits(docs.filter("false")).count() == 0


def test_positions_count_down_in_a_pick():
    assert POSITIONS == 1 << 24 and PRIME * BASE + 2**32 < 2**63


def test_no_python_in_the_plan(spark):
    plan = compare_with_edits(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
