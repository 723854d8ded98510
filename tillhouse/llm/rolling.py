"""Hashes of words and of runs of words, for whole batches of texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+``. All arithmetic is polynomial and modulo 2**64, so numpy does it
for a batch at once; a long text is no different from many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

MASK = (1 << 64) - 1
# Text bytes that are hashed together: the working arrays take about 60 bytes for each.
CHUNK = 1 << 20


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


BYTE_VALUES = np.array([_splitmix(i) | 1 for i in range(256)], np.uint64)
BYTE_BASE = _splitmix(1001) | 1
# Bases of the two hashes of a run of words.
BASES = (_splitmix(2001) | 1, _splitmix(3001) | 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble, so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: Sequence[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and where each text's words begin (one more entry ends
    the last). ``lower`` lower-cases A-Z first."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # A blank after each text keeps its last word from meeting the next text.
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths + 1))))
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    terms = BYTE_VALUES[data[inside]] * _powers(int(size.max()), BYTE_BASE)[place]
    return mixed(np.add.reduceat(terms, first)), bounds


def run_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each k consecutive words: ``sum(word[i + j] * base ** (k - 1 - j))``.

    Runs are put together from runs of half the length, which costs log2(k) passes. The result
    has an entry for each word; the last k - 1 are of no use."""
    n = len(words)
    done, out, length = 0, np.zeros(n, np.uint64), 1
    part = words.copy()
    while True:
        if k & length:
            shifted = np.zeros(n, np.uint64)
            shifted[: max(0, n - done)] = part[done:]
            out = out * np.uint64(pow(base, length, 1 << 64)) + shifted
            done += length
        length *= 2
        if length > k:
            return mixed(out)
        half = length // 2
        moved = np.zeros(n, np.uint64)
        moved[: max(0, n - half)] = part[half:]
        part = part * np.uint64(pow(base, half, 1 << 64)) + moved


def chunks(ids: Sequence, texts: Sequence[str | None], size: int = CHUNK) -> Iterator[tuple[list, list]]:
    """Texts as bytes in groups of about ``size``; a null text is empty."""
    held, own, total = [], [], 0
    for i, text in zip(ids, texts, strict=True):
        data = text.encode() if text else b""
        held.append(data)
        own.append(i)
        total += len(data) + 1
        if total >= size:
            yield own, held
            held, own, total = [], [], 0
    if held:
        yield own, held
