"""Licence scan: texts against licence notices and full licences by the Dice coefficient over word bigrams.

The units are the whole text, each of its lines, and windows of words that go across line ends
or lie inside a longer line. A unit is normalised to lower-case words of ``[a-z0-9]``; its bigrams
count with repeats. The coefficient of two units of n and m bigrams is at most
``2 * min(n, m) / (n + m)``, which bounds a window's length.

A text that shares too few bigrams with every template for any unit to reach the threshold, as
nearly all do, is done after one lookup per word. Otherwise windows start and end at a shared
bigram (others only lower the coefficient); starts from which no window can reach the threshold
even if every repeat counted are left out, and each other start takes its best end. Of windows of
one template that overlap, the best stays. A window is no unit of its own where half of its words
or more lie in a line, text or other window that has a coefficient at least as high.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tillhouse.llm.workspace import importable

PERCENT = 75
# Cells of the matrices in which windows are compared.
MATRIX = 1 << 17
STRETCH = 64
# Usual wordings of licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile("[A-Za-z0-9]+")


def bodies() -> tuple[tuple[str, str], ...]:
    """Full licence texts, a file each."""
    folder = Path(__file__).with_name("licenses")
    return tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted(folder.glob("*.txt")))


class Scanner:
    """Templates as counts of numbered bigrams."""

    def __init__(self, templates: Sequence[tuple[str, str]], percent: int):
        self.names, self.percent = [name for name, _ in templates], percent
        self.ids: dict[str, int] = {}
        texts = [[self.ids.setdefault(w.lower(), len(self.ids)) for w in WORD.findall(t)] for _, t in templates]
        pairs = [self._codes(np.array(t, np.int64)) for t in texts]
        self.codes = np.unique(np.concatenate(pairs))
        self.counts = np.zeros((len(pairs), len(self.codes)), np.int64)
        for row, own in zip(self.counts, pairs, strict=True):
            np.add.at(row, np.searchsorted(self.codes, own), 1)
        self.m = self.counts.sum(1)
        # Shared bigrams that any unit needs.
        self.least = -(-percent * self.m // (200 - percent))

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids[:-1] < 0) | (ids[1:] < 0), -1, (ids[:-1] << 32) | ids[1:])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of the bigram at each place, -1 where no template has it."""
        get = self.ids.get
        codes = self._codes(np.fromiter((get(w.lower(), -1) for w in words), np.int64, len(words)))
        found = np.full(len(codes), -1)
        at = np.flatnonzero(codes >= 0)
        spot = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[spot] == codes[at]
        found[at[same]] = spot[same]
        return found

    def shared(self, found: np.ndarray) -> np.ndarray:
        """Bigrams in common with each template."""
        own, times = np.unique(found[found >= 0], return_counts=True)
        return np.minimum(self.counts[:, own], times).sum(1)

    def hits(self, found: np.ndarray) -> list[tuple[str, float]]:
        """Licences that a unit reaches the threshold for."""
        both, total = self.shared(found), len(found) + self.m
        near = np.flatnonzero(200 * both >= self.percent * total)
        return [(self.names[t], 2.0 * int(both[t]) / int(total[t])) for t in near]

    def windows(self, found: np.ndarray, t: int) -> list[tuple[float, int, int]]:
        """Windows without overlap: coefficient, first bigram and last bigram."""
        m, percent = int(self.m[t]), self.percent
        place = np.flatnonzero(found >= 0)
        place = place[self.counts[t, found[place]] > 0]
        # A repeat counts from the start of a window if the one as many before as the template has is outside.
        held, outside = defaultdict(list), np.full(len(place), -1)
        for k, b in enumerate(found[place].tolist()):
            own, cap = held[b], int(self.counts[t, b])
            if len(own) >= cap:
                outside[k] = own[-cap]
            own.append(k)
        nth = np.arange(len(place))
        upto = 200 * (nth + 1) - percent * (place + 1)
        reach = np.maximum.accumulate(upto[::-1])[::-1] - (200 * nth - percent * place)
        most = m * (200 - percent) // percent

        def best(i: int, limit: int) -> tuple | None:
            """The best window that starts at shared bigram ``i`` and ends before ``limit``."""
            stop = np.searchsorted(place, min(place[i] + most, limit))
            both, n = np.cumsum(outside[i:stop] < i), place[i:stop] - place[i] + 1
            fits = 200 * both >= percent * (n + m)
            if not fits.any():
                return None
            dice = np.where(fits, 2.0 * both / (n + m), 0.0)
            j = int(dice.argmax())
            return -float(dice[j]), -int(n[j]), i, int(place[i + j])

        # The best window of every start, many starts at a time: a row of the matrix is a start.
        end, starts = len(found), np.flatnonzero(reach >= percent * m)
        width = min(most, len(place))
        padded_place = np.append(place, np.full(width, place[-1] + 2 * most if len(place) else 0))
        padded_outside = np.append(outside, np.full(width, len(place)))
        queue = []
        for some in np.array_split(starts, max(1, len(starts) * width // MATRIX)):
            if not len(some):
                continue
            spots = some[:, None] + np.arange(width)
            both = np.cumsum(padded_outside[spots] < some[:, None], axis=1)
            n = padded_place[spots] - place[some][:, None] + 1
            fits = (n <= most) & (200 * both >= percent * (n + m))
            dice = np.where(fits, 2.0 * both / (n + m), 0.0)
            at = dice.argmax(1)
            row = np.arange(len(some))
            ok = np.flatnonzero(fits[row, at])
            value, length = -dice[row, at], -n[row, at]
            last = place[np.minimum(some + at, len(place) - 1)]
            queue += zip(value[ok].tolist(), length[ok].tolist(), some[ok].tolist(), last[ok].tolist(), strict=True)
        heapq.heapify(queue)
        # Taken windows lie apart, so both lists are sorted alike.
        firsts: list[int] = []
        taken: list[tuple[float, int, int]] = []
        while queue:
            dice, _, i, last = heapq.heappop(queue)
            first = int(place[i])
            # Windows share no word: a bigram reaches one word further than its place.
            behind = bisect_right(firsts, first + 1)
            if behind and (firsts[behind - 1] == first + 1 or first <= taken[behind - 1][2] + 1):
                continue
            limit = firsts[behind] - 1 if behind < len(firsts) else end
            if last < limit:
                firsts.insert(behind, first)
                taken.insert(behind, (-dice, first, last))
            elif (again := best(i, limit)) is not None:
                heapq.heappush(queue, again)
        return taken

    def scan(self, text: str) -> list[tuple[str, str, float]]:
        """Unit, licence and coefficient of each hit of a text."""
        words = WORD.findall(text)
        if len(words) < 2:
            return []
        found = self.numbers(words)
        matched = found >= 0
        if np.count_nonzero(matched) < self.least.min():
            return []
        likely = np.flatnonzero(self.shared(found) >= self.least)
        if not len(likely):
            return []
        spans = [w.span() for w in WORD.finditer(text)]
        starts = np.array([a for a, _ in spans])
        passed = np.concatenate([[0], np.cumsum(matched)])
        # Units that have a coefficient, by the stretches of text that they lie in.
        rows, covers = {}, defaultdict(list)

        def unit(body: str, first: int, last: int) -> None:
            """The words from ``first`` up to ``last``, not included."""
            if last - first < 2 or passed[last - 1] - passed[first] < self.least.min():
                return
            if own := self.hits(found[first : last - 1]):
                cover = first, last, max(dice for _, dice in own)
                for stretch in range(first // STRETCH, (last - 1) // STRETCH + 1):
                    covers[stretch].append(cover)
                rows[body] = own

        offset = 0
        for line in text.split("\n"):
            first, last = np.searchsorted(starts, [offset, offset + len(line)])
            unit(line, int(first), int(last))
            offset += len(line) + 1
        unit(text, 0, len(words))
        tried = [w for t in likely for w in self.windows(found, t)]
        for dice, a, b in sorted(tried, key=lambda w: (-w[0], w[1] - w[2], w[1])):
            size = b + 2 - a
            # What holds half of a window holds a word of its middle.
            middle = {(a + (size - 1) // 2) // STRETCH, (a + size // 2) // STRETCH}
            near = (cover for stretch in middle for cover in covers[stretch])
            if not any(2 * (min(y, b + 2) - max(x, a)) >= size and c >= dice for x, y, c in near):
                unit(text[spans[a][0] : spans[b + 1][1]], a, b + 2)
        return [(body, name, dice) for body, own in rows.items() for name, dice in own]


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] | None = None,
    percent: int = PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``license``, ``dice`` (the best), ``n_units`` (that reach the threshold).

    A row per document and licence found; documents without a licence, and null or empty texts,
    give no row. A unit counts for every licence that it reaches the threshold for. Templates
    (the notices and full licences, if none are given) have two words at least. Rows that repeat
    an id are counted together.
    """
    importable(docs.sparkSession)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    templates = (*TEMPLATES, *bodies()) if templates is None else tuple(templates)
    shape = StructType([
        rows.schema["doc_id"],
        StructField("unit", StringType()),
        StructField("license", StringType()),
        StructField("dice", DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, percent)
        for batch in batches:
            at, hits = [], []
            for i in range(batch.num_rows):
                own = scanner.scan(batch.column(1)[i].as_py())
                at += [i] * len(own)
                hits += own
            units, names, dice = zip(*hits, strict=True) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int32())),
                    pa.array(units, pa.string()),
                    pa.array(names, pa.string()),
                    pa.array(dice, pa.float64()),
                ],
                ["doc_id", "unit", "license", "dice"],
            )

    return (
        rows.mapInArrow(run, shape)
        .groupBy("doc_id", "license", "unit")
        .agg(F.max("dice").alias("dice"))
        .groupBy("doc_id", "license")
        .agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"))
    )
