"""Each operator against a brute-force version, on awkward rows and on none at all."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tillhouse.llm import quality
from tillhouse.llm.byte_bpe import Coder, decode, encode, read_ranks, round_trip
from tillhouse.llm.embedding_dedup import embedding_dedup
from tillhouse.llm.exact_dedup import DigestIndex, digests, exact_dedup
from tillhouse.llm.jaccard_join import jaccard_join
from tillhouse.llm.license_scan import scan_licenses
from tillhouse.llm.mixing import mix, repeat_documents
from tillhouse.llm.sharding import shard_documents
from tillhouse.llm.substring_dedup import substring_dedup
from tillhouse.llm.url_filter import filter_urls
from tillhouse.llm.workspace import Workspace

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, id string, digest int"


def sample():
    """Texts of a small vocabulary: copies, near copies, shared passages, blanks, nulls, long ones."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    vocabulary = [word() for _ in range(400)]
    passage = [word() for _ in range(30)]
    texts = [None, "", "  \t\n", "one", "A b", "a  B", "x y z w", "a b a b a b a b a b"]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        texts.append("\n".join([" ".join(words), " ".join(passage)]) if i % 2 else " ".join(words))
    texts += ["same text of six words here"] * 25 + ["SAME text\tof six  words here"] * 3
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, 1, "x", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    found = {r[key]: r for r in df.collect()}
    return found


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def test_exact_dedup(docs, rows, nothing):
    got = by_id(exact_dedup(docs))
    norm = {}
    import re

    for i, t, *_ in rows:
        norm[i] = re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, text in norm.items():
        same = [j for j in norm if norm[j] == text]
        assert got[i].keep_id == min(same) and got[i].group_size == len(same)
        assert got[i].kept == (i == min(same))
        assert bytes(got[i].digest) == hashlib.sha256(text.encode()).digest()
    assert exact_dedup(nothing).count() == 0


def test_a_digest_index_keeps_what_it_has_seen(spark, docs):
    work = Workspace(spark, "test-index")
    index = DigestIndex(spark, f"{work.root}/i", "test_digests", 4)
    batch = digests(docs)
    index.add(batch.filter("doc_id >= 60"))
    before = index.read().count()
    index.add(batch.filter("doc_id >= 60"))
    assert index.read().count() == before
    got = by_id(exact_dedup(docs, index=index))
    early = min(i for i in got if i >= 60 and bytes(got[i].digest) == bytes(got[90].digest))
    assert got[90].keep_id == early
    joined = batch.join(index.read().hint("merge"), "digest", "left_anti")
    assert "Bucketed: true" in joined._jdf.queryExecution().executedPlan().toString()


def test_jaccard_join(docs, rows, nothing):
    sets = {}
    for i, t, *_ in rows:
        w = lowered(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in label):
            break
    got = by_id(jaccard_join(docs))
    assert {i: got[i].component_id for i in got} == label
    assert {i: got[i].n_shingles for i in got} == {i: len(s) for i, s in sets.items()}
    assert jaccard_join(nothing).count() == 0


def test_substring_dedup(docs, rows, nothing):
    seen, want = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone.update(range(j, j + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()}
    assert got == want
    assert substring_dedup(nothing).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    odd = [(None, long), (None, None), (1, long), (1, long), (2, long), (3, "a b c d e f")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string")
    for result in (
        exact_dedup(df),
        jaccard_join(df),
        substring_dedup(df),
        shard_documents(df),
        mix(df.withColumn("source", F.lit("s"))),
        encode(df, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN),
    ):
        assert len(result.collect()) == len(odd)
    removed = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(df).collect())
    assert removed == [(0, 0), (0, 60), (1, 0), (1, 0), (2, 60), (3, 0)]


def test_byte_bpe_is_what_tiktoken_gives(docs, rows, nothing):
    data = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = Coder.of(data).ranks
    tool = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(round_trip(docs, data, public_tokenizers.PATTERN))
    for i, t, *_ in rows:
        ids = np.frombuffer(bytes(got[i].ids), "<u4").tolist()
        assert ids == tool.encode_ordinary(t or "") and got[i].n_tokens == len(ids)
        assert bytes(got[i].decoded) == (t or "").encode()
    apart = by_id(decode(encode(docs, data, public_tokenizers.PATTERN), data))
    assert {i: bytes(r.decoded) for i, r in apart.items()} == {i: bytes(r.decoded) for i, r in got.items()}
    coder = Coder.of(data)
    for text in ("é" * 300, "ab" * 400, "日本語テキスト" * 9, "áὠ0 \x1c\x85!"):
        pieces = __import__("regex").findall(public_tokenizers.PATTERN, text)
        assert np.frombuffer(coder.encode([pieces])[0], "<u4").tolist() == tool.encode_ordinary(text)
    assert round_trip(nothing, data, public_tokenizers.PATTERN).count() == 0


def test_sharding(docs, rows, nothing):
    got = by_id(shard_documents(docs, 5))
    shards = {}
    for i, t, *_ in rows:
        body = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len(body) + 1, zlib.crc32(body), "rows")
        shards.setdefault(got[i].shard, []).append(got[i].slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert set(shards) == set(range(5))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    # The 25 equal texts do not fit one shard, which has other groups too; they started in all.
    same = [got[i].shard for i, t, *_ in rows if t == "same text of six words here"]
    assert max(map(same.count, same)) >= 12
    assert shard_documents(nothing).count() == 0


def test_mixing(docs, rows, nothing):
    got = by_id(mix(docs))
    sizes = {}
    for i, t, _, s, *_ in rows:
        n = len((t or "").encode().split())
        assert got[i].size == n and got[i].taken <= 3 * n
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        want = 3 * sizes[s] if s in full else rest * weight[s] / total
        own = [r for r in got.values() if r.source == s]
        assert all(math.isclose(r.target, want) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want) <= 0.05 * want
    assert by_id(mix(docs.repartition(2))) == got
    assert mix(nothing).count() == 0
    assert repeat_documents(docs).columns == docs.columns


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    near = base[:12] + rng.normal(size=(12, 16)) * 0.07
    crowd = base[:1] + rng.normal(size=(60, 16)) * 0.1
    vectors = [v.tolist() for v in np.concatenate([base, near, crowd, base[:5], base[:1], base[:1]])]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0] * 8, []]
    data = [(i, v, i % 2 if i < 40 else 0) for i, v in enumerate(vectors + odd)]
    data.append((len(data), vectors[0], None))
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int")
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, g in data if g is not None and v and None not in v
          and np.isfinite(v).all() and any(v)}
    near_to = {
        a: {b for b in ok if a != b and data[a][2] == data[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.93}
        for a in ok
    }
    label = {i: i for i, *_ in data}
    for _ in range(20):
        label.update({a: min([label[a], *(label[b] for b in near_to[a])]) for a in near_to})
    for options in ({}, {"cell_rows": 10}):
        got = by_id(embedding_dedup(df, **options), "vec_id")
        assert {i: r.n_links for i, r in got.items()} == {i: len(near_to.get(i, ())) for i, *_ in data}
        assert {i: r.component_id for i, r in got.items()} == label
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup(df.limit(0)).count() == 0


def test_licenses(spark, nothing):
    data = [
        (1, "Some words.\nReleased under the MIT License."),
        (2, "licensed under cc by-nc 4.0"),
        (3, None),
        (4, ""),
        (5, "nothing of that kind"),
        (6, "Released under the MIT licence\nReleased under the MIT License!"),
    ]
    got = scan_licenses(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.license, r.n_units) for r in got} >= {(1, "MIT", 2), (2, "CC-BY-NC-4.0", 1)}
    assert {r.doc_id for r in got} == {1, 2, 6}
    assert all(0.75 <= r.dice <= 1 for r in got)
    assert scan_licenses(nothing).count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    data, labels = [], []
    for i in range(400):
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        good = i % 5 != 0
        text = " ".join(body) + "." if good else " | ".join(body) if i % 2 else " ".join(w.upper() + "!!" for w in body)
        data.append((i, text))
        if i % 3:
            labels.append((i, int(good)))
    data += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = by_id(quality.score(docs, quality.train(docs, known)))
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in data)
    unseen = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 5 != 0) for i in unseen) >= 0.95 * len(unseen)
    none = docs.limit(0)
    assert quality.score(none, quality.train(none, known.limit(0))).count() == 0


def test_urls(spark):
    link = '<a href="{}">x</a>'
    data = [
        (1, "http://A.example.NET/en/1?q", link.format("https://friend.org/x")),
        (2, "https://x.net/a", None),
        (3, "http://b.example.com/de/1#f", ""),
        (4, "http://friend.org/y", link.format("//pal.info/")),
        (5, "http://feeder.info/", link.format("http://b.example.com/de/2") + link.format("/self")),
        (6, "http://pal.info", None),
        (7, None, None),
        (8, "no url", "x"),
        (9, "http://s.org/fr/1", None),
        (10, "http://unrelated.info/en/", link.format("http://unrelated.info/")),
    ]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    got = by_id(filter_urls(pages), "page_id")
    assert [got[i].rule for i in range(1, 11)] == [
        "example.net/en/", "net/", "example.com/de/", None, None, None, None, None, "org/fr/", None,
    ]
    assert got[1].host == "a.example.net" and got[1].path == "/en/1"
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "")
    assert [got[i].verdict for i in range(1, 11)] == [
        "allow", "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow",
    ]
    # By hand: a.example.net and s.org are full seeds of trust, b.example.com is one of distrust.
    assert math.isclose(got[4].trust, 0.85) and math.isclose(got[6].trust, 0.85**2)
    assert math.isclose(got[5].distrust, 0.85) and got[3].distrust == got[2].distrust == 1.0
    assert filter_urls(pages.limit(0)).count() == 0
