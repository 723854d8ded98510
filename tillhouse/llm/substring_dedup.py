"""Substring dedup: every window of 20 words that occurs before is removed.

1. Each block of documents hashes all its windows (Rabin-Karp) and keeps the first place of
   each; the others are repeats for certain. So a passage that half of all documents share
   costs one record per block, not one per document.
2. The records meet by the leading bits of the hash, packed as arrays. Whatever is not the
   first place of its window is a repeat.
3. Repeats return to their document, where overlapping windows merge into maximal intervals.

The first place is the smallest (id, position). Rows without an id come after all others, each
distinct text as a document of its own, in the order of a hash of their texts (so ids lie below 2^62).
Rows that repeat an id, or a text without one, count as one document: a window is no repeat of
itself in the other row, and what is removed in one is removed in the other. Windows are told apart by 72 bits of two hashes, so
over n windows about n**2 / 2**73 are taken for repeats by chance: none at a billion documents.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.rolling import BASES, chunks, run_hashes, word_hashes
from tillhouse.llm.workspace import Workspace, task_count, text_bytes

WINDOW = 20
# Text bytes in a block of documents.
BLOCK_BYTES = 8 << 20
NO_ID = 1 << 62  # rows without an id are numbered from here on: they sort last

PACKED = "part int, dest int, body binary"
RESULT = (
    "doc_id bigint, n_words bigint, n_removed bigint, "
    "removed array<struct<start:bigint,end:bigint>>, kept string"
)


def _key(doc: int | None, text: bytes) -> int:
    """The number a row is dealt and ordered by: its id, or one made of its text."""
    if doc is not None:
        return doc
    return NO_ID | int.from_bytes(hashlib.blake2b(text, digest_size=8).digest()) >> 2


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: small numbers leave runs of zeros, which compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(data: memoryview, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def _pack(docs: np.ndarray, spots: np.ndarray, high: np.ndarray | None = None, low=None) -> bytes:
    """Places sorted by (document, position), with 8 bytes of hash each if given."""
    new = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    count = np.diff(np.append(new, len(docs))).astype(np.uint32)
    steps = np.diff(spots, prepend=0).astype(np.uint32)
    steps[new] = spots[new]
    ids = np.diff(docs[new], prepend=0).astype(np.int64)
    head = np.array([len(docs), len(new), high is not None], np.int64).tobytes()
    body = [head, _planes(ids), _planes(count), _planes(steps)]
    if high is not None:
        # The part gives the first bits of the hash; a byte of the second hash takes its place.
        body += [(high & np.uint64((1 << 56) - 1) | (low >> np.uint64(56) << np.uint64(56))).tobytes()]
    return b"".join(body)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    view = memoryview(body)
    n, m, hashed = (int(x) for x in np.frombuffer(view, np.int64, 3))
    at = 24
    ids = np.cumsum(_from_planes(view[at:], np.int64, m))
    at += 8 * m
    count = _from_planes(view[at:], np.uint32, m)
    at += 4 * m
    steps = _from_planes(view[at:], np.uint32, n).astype(np.int64)
    at += 4 * n
    total = np.cumsum(steps)
    first = np.cumsum(count) - count
    spots = total - np.repeat(total[first] - steps[first], count)
    return np.repeat(ids, count), spots, np.frombuffer(view[at:], np.uint64, n) if hashed else None


def _destination(docs: np.ndarray, n: int) -> np.ndarray:
    h = docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def _to_documents(docs: np.ndarray, spots: np.ndarray, targets: int) -> Iterator[tuple[int, bytes]]:
    """Repeats, packed for the task that has their document."""
    if not len(docs):
        return
    dest = _destination(docs, targets)
    order = np.lexsort((spots, docs, dest))
    dest, docs, spots = dest[order], docs[order], spots[order]
    cuts = np.flatnonzero(np.diff(dest, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(dest)), strict=True):
        yield int(dest[a]), _pack(docs[a:b], spots[a:b])


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["part", "dest", "body"], [pa.int32(), pa.int32(), pa.binary()])


def _repeats(docs: np.ndarray, spots: np.ndarray, order: np.ndarray, new: np.ndarray) -> tuple:
    """Of places in runs of equal hash (``new`` marks the first of a run), the smallest of each run
    and whether the others are larger: returns (first of run, repeated) as masks over places."""
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    first = np.zeros(len(docs), bool)
    first[order[new & (size[run] == 1)]] = True
    many = np.flatnonzero(size[run] > 1)
    repeated = np.zeros(len(docs), bool)
    if len(many):
        at, own = order[many], run[many]
        by = np.lexsort((spots[at], docs[at], own))
        at, own = at[by], own[by]
        head = np.diff(own, prepend=-1) != 0
        lead = at[head][np.cumsum(head) - 1]
        later = (docs[at] != docs[lead]) | (spots[at] != spots[lead])
        first[at[head]] = True
        repeated[at[later]] = True
    return first, repeated


def _hash_windows(k: int, targets: int, bits: int, block: int = BLOCK_BYTES):
    def flush(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        parts = []
        by_id = sorted(range(len(ids)), key=ids.__getitem__)
        own, held = [ids[i] for i in by_id], [texts[i] for i in by_id]
        for some, bodies in chunks(own, held):
            words, bounds = word_hashes(bodies)
            usable = np.maximum(0, np.diff(bounds) - k + 1)
            if not usable.sum():
                continue
            at = np.repeat(bounds[:-1], usable) + _counting(usable)
            high, low = (run_hashes(words, k, b)[at] for b in BASES)
            parts.append((np.repeat(np.array(some, np.int64), usable), _counting(usable), high, low))
        if not parts:
            return
        docs, spots, high, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new = _equal_runs(high, low)
        first, repeated = _repeats(docs, spots, order, new)
        rows = [(-1 - dest, dest, body) for dest, body in _to_documents(docs[repeated], spots[repeated], targets)]
        keep = np.flatnonzero(first)
        part = (high[keep] >> np.uint64(64 - bits)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        keep, part = keep[by_part], part[by_part]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
            own = keep[a:b]
            rows.append((int(part[a]), None, _pack(docs[own], spots[own], high[own], low[own])))
        for i in range(0, len(rows), 64):
            yield _packed(rows[i : i + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(_key(doc, (text or "").encode()))
                texts.append(text)
                held += len(text or "")
                if held >= block:
                    yield from flush(ids, texts)
                    ids, texts, held = [], [], 0
        yield from flush(ids, texts)

    return run


def _counting(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n - 1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _equal_runs(high: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where a new hash begins in it."""
    order = np.argsort(high, kind="stable")
    if low is None:
        h = high[order]
        return order, np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    # One hash, another second hash: only then both are needed to sort.
    h, o = high[order], low[order] >> np.uint64(56)
    if ((h[1:] == h[:-1]) & (o[1:] != o[:-1])).any():
        order = np.lexsort((low >> np.uint64(56), high))
        h, o = high[order], low[order] >> np.uint64(56)
    return order, np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool)


def _find_repeats(targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            through = []
            for part, dest, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    through.append((part, dest, body))
                else:
                    held[part].append(body)
            if through:
                yield _packed(through)
        found = []
        for part in list(held):
            docs, spots, key = (np.concatenate(x) for x in zip(*map(_unpack, held.pop(part)), strict=True))
            order, new = _equal_runs(key)
            _, repeated = _repeats(docs, spots, order, new)
            found.append((docs[repeated], spots[repeated]))
        if found:
            docs, spots = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = [(-1 - dest, dest, body) for dest, body in _to_documents(docs, spots, targets)]
            for i in range(0, len(rows), 256):
                yield _packed(rows[i : i + 256])

    return run


def _squeeze(targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            dest = _destination(np.array([_key(i, t) for i, t in zip(ids, texts, strict=True)], np.int64), targets)
            bodies = [pack(t) for t in texts]
            yield _batch(
                list(zip(dest.tolist(), ids, bodies, [None] * len(ids), strict=True)),
                ["dest", "doc_id", "body", "repeats"],
                [pa.int32(), pa.int64(), pa.binary(), pa.binary()],
            )

    return run


def _remove(k: int):
    names = ["doc_id", "n_words", "n_removed", "removed", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), span, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], []
        for batch in batches:
            for _, doc, body, repeats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((doc, body)) if repeats is None else found.append(repeats)
        if found:
            docs, spots, _ = zip(*map(_unpack, found), strict=True)
            docs, spots = np.concatenate(docs), np.concatenate(spots)
            order = np.lexsort((spots, docs))
            docs, spots = docs[order], spots[order]
        else:
            docs = spots = np.empty(0, np.int64)
        open_ = zstandard.ZstdDecompressor().decompress
        rows, size = [], 0
        for doc, body in held:
            text = open_(body)
            words, key = text.split(), _key(doc, text)
            a, b = np.searchsorted(docs, key, "left"), np.searchsorted(docs, key, "right")
            spans, gone, kept = [], 0, words
            if b > a:
                starts = np.unique(spots[a:b])
                starts = starts[starts < len(words)]
                cut = np.flatnonzero(np.diff(starts) > k)
                lo = starts[np.append(0, cut + 1)] if len(starts) else starts
                hi = np.minimum(starts[np.append(cut, len(starts) - 1)] + k, len(words)) if len(starts) else starts
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)]
                gone = int((hi - lo).sum())
                kept, at = [], 0
                for s in spans:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
            rows.append((doc, len(words), gone, spans, b" ".join(kept).decode()))
            size += len(body)
            if len(rows) >= 4096 or size >= 4 << 20:
                yield _batch(rows, names, types)
                rows, size = [], 0
        yield _batch(rows, names, types)

    return run


def substring_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``removed`` (maximal intervals of word numbers) and
    ``kept`` (the words left, joined by one space), a row per document.

    A null text has no words; a text shorter than the window loses nothing. Texts are never cut:
    one text is the least that a task holds. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring-dedup")
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    tasks = task_count(spark, text_bytes(docs, text))
    # Windows are dealt out by the leading bits of their hash, some parts to each task.
    bits = max(8, math.ceil(math.log2(4 * tasks)))
    windows = rows.mapInArrow(_hash_windows(window, tasks, bits), PACKED)
    found = windows.repartition(tasks, "part").mapInArrow(_find_repeats(tasks), PACKED)
    found = work.save(found.select("dest", F.col("body").alias("repeats")), "repeats")
    shape = "dest int, doc_id bigint, body binary, repeats binary"
    texts = rows.mapInArrow(_squeeze(tasks), shape)
    gone = found.select("dest", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("body"), "repeats")
    return texts.unionByName(gone).repartition(tasks, "dest").mapInArrow(_remove(window), RESULT)
