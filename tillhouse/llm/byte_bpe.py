"""Byte-level BPE with DuckDB inside the tasks of a Spark job.

Encoding: a text is split by the tokenizer's pattern. Each distinct piece that is no token as
a whole becomes rows (word, position, token), first one row per byte. A recursive query joins
neighbours with the merge table and contracts each word's leftmost pair of least rank, until no
pair of any word is left. Decoding: token rows join the vocabulary and are ordered by place; the
answer's column of bytes is the text, and each document takes its share of it.

The recursive query keeps every turn's rows and takes a turn per contraction of a word, so
pieces above ``LONG`` bytes go another way: a queue of their pairs by rank and place, contracted
in the same order, in time n log n.

The encoded pieces are remembered inside a task, up to a bound; that saves work and changes no
result. A query takes a bounded number of rows, of which a long document makes several. What
is left grows with the longest document and the longest piece: they are held in Python as
the row, its pieces and ids, and for a long piece its queue.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.workspace import importable, tidy

# Rows of one query, contractions of a word in one query, pieces remembered by a task.
QUERY_ROWS = 150_000
TURNS = 24
REMEMBERED = 400_000
DECODE_ROWS = 250_000
# Bytes from which a piece is contracted by a queue; shorter ones are words of a query.
LONG = 4_096
# Text characters that are encoded together.
BATCH = 2 << 20

# A row is a token of a word: its place, its id and the id to its right. ``best`` has the leftmost
# pair of least rank of each word that has a pair; ``hit`` adds what follows that pair.
STEPS = f"""
WITH RECURSIVE steps AS (
    SELECT word, idx, id, following, 0 AS turn FROM todo
    UNION ALL
    (WITH best AS (
        SELECT word, min((m.merged::BIGINT << 31) | s.idx) AS choice
        FROM steps s JOIN merges m ON m.pair = (s.id::BIGINT << 32) | s.following
        WHERE turn < {TURNS}
        GROUP BY word
    ), hit AS (
        SELECT b.word, (choice & 2147483647)::INTEGER AS spot, (choice >> 31)::INTEGER AS merged,
               n.following
        FROM best b JOIN steps n ON n.word = b.word AND n.idx = (choice & 2147483647) + 1
    )
    SELECT s.word, s.idx - (s.idx > h.spot)::INTEGER,
           CASE WHEN s.idx = h.spot THEN h.merged ELSE s.id END,
           CASE WHEN s.idx = h.spot THEN h.following
                WHEN s.idx = h.spot - 1 THEN h.merged ELSE s.following END,
           s.turn + 1
    FROM steps s JOIN hit h ON h.word = s.word
    WHERE s.idx <> h.spot + 1)
)
SELECT s.word, s.idx, s.id, s.turn
FROM steps s JOIN (SELECT word, max(turn) AS turn FROM steps GROUP BY word) t USING (word, turn)
"""

DECODE = "SELECT body FROM tokens JOIN vocabulary USING (id) ORDER BY pos"


def read_ranks(path: str) -> bytes:
    """A rank file: base64 of the token, a blank and its rank, on each line."""
    with open(path, "rb") as file:
        return file.read()


class Coder:
    """Merge table and vocabulary in an in-memory database of one Python worker."""

    made: dict[int, Coder] = {}

    def __init__(self, data: bytes):
        lines = map(bytes.split, data.splitlines())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.seen: dict[str, bytes] = {}
        self._db: duckdb.DuckDBPyConnection | None = None
        self._merges: pa.Table | None = None
        self.has_merges = False

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        if self._db is None:
            config = {"threads": 1, "memory_limit": "200MB", "temp_directory": ""}
            self._db = duckdb.connect(config=config)
            self._table("v", id=list(self.ranks.values()), body=list(self.ranks))
            self._db.execute("CREATE TABLE vocabulary AS SELECT id::INTEGER AS id, body FROM v")
            self._db.unregister("v")
        return self._db

    def close(self) -> None:
        """End the database. The worker goes on to other operators' tasks; a later one of this operator
        makes the tables again, which takes it a moment, and finds the remembered pieces."""
        if self._db is not None:
            self._db.close()
        self._db, self.has_merges = None, False

    def _merge_table(self) -> None:
        """All pairs of tokens that make a token: encoding needs them, decoding does not."""
        if self.has_merges:
            return
        if self._merges is None:
            get = self.ranks.get
            pairs, merged = [], []
            for token, rank in self.ranks.items():
                for i in range(1, len(token)):
                    left, right = get(token[:i]), get(token[i:])
                    if left is not None and right is not None:
                        pairs.append((left << 32) | right)
                        merged.append(rank)
            self._merges = pa.table({"pair": np.array(pairs, np.int64), "merged": np.array(merged, np.int32)})
        self.db.register("m", self._merges)
        self.db.execute("CREATE TABLE merges AS FROM m")
        self.db.unregister("m")
        self.has_merges = True

    @classmethod
    def of(cls, data: bytes) -> Coder:
        key = hash(data)
        if key not in cls.made:
            cls.made = {key: cls(data)}
        return cls.made[key]

    def _table(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed. Words that need more turns go round again."""
        self._merge_table()
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        idx = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word, idx = word.astype(np.int32), idx.astype(np.int32)
        done = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        while len(word):
            following = np.append(ids[1:], -1).astype(np.int32)
            following[np.append(word[1:] != word[:-1], True)] = -1
            self._table("todo", word=word, idx=idx, id=ids, following=following)
            out = self.db.execute(STEPS).fetchnumpy()
            word, idx, ids, turn = (np.asarray(out[c]) for c in ("word", "idx", "id", "turn"))
            more = turn >= TURNS
            for held, new in zip(done, (word, idx, ids), strict=True):
                held.append(new[~more])
            order = np.lexsort((idx[more], word[more]))
            word, idx, ids = (x[more][order] for x in (word, idx, ids))
        word, idx, ids = map(np.concatenate, done)
        order = np.lexsort((idx, word))
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        data = ids[order].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _contract_long(self, word: bytes) -> bytes:
        """Packed ids of one word: the leftmost pair of least rank first, as in the query."""
        get, n = self.ranks.get, len(word)
        # By where a token starts: the start of the next, of the one before, and the pair's rank.
        after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
        rank = array("q", (get(word[i : i + 2], -1) for i in range(n - 1)))
        rank.extend([-1, -1])
        queue = [(r << 32) | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(queue)
        while queue:
            choice = heapq.heappop(queue)
            here = choice & 0xFFFFFFFF
            if rank[here] != choice >> 32:
                continue  # contracted otherwise since
            gone = after[here]
            end = after[gone]
            after[here], rank[gone] = end, -1
            if end < n:
                before[end] = here
            for left in (before[here], here):
                right = after[left] if left >= 0 else n
                if right < n:
                    rank[left] = new = get(word[left : after[right]], -1)
                    if new >= 0:
                        heapq.heappush(queue, (new << 32) | left)
                elif left >= 0:
                    rank[left] = -1
        ids, here = array("I"), 0
        while here < n:
            ids.append(self.ranks[word[here : after[here]]])
            here = after[here]
        return np.array(ids, "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces: those that are a token as a whole, and the others by contraction."""
        names, words, rows = [], [], 0

        def flush():
            self.seen.update(zip(names, self._contract(words), strict=True))
            names.clear(), words.clear()

        for piece in pieces:
            body = piece.encode()
            whole = self.ranks.get(body)
            if whole is not None:
                self.seen[piece] = whole.to_bytes(4, "little")
                continue
            if len(body) > LONG:
                self.seen[piece] = self._contract_long(body)
                continue
            if rows + len(body) > QUERY_ROWS and words:
                flush()
                rows = 0
            names.append(piece), words.append(body)
            rows += len(body)
        if words:
            flush()

    def encode(self, docs: list[list[str]]) -> list[bytes]:
        """Packed ids of documents that are split into pieces."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        get = self.seen.get
        known = [list(map(get, own)) for own in docs]
        missing = set()
        for own, ids in zip(docs, known, strict=True):
            if None in ids:
                missing.update(p for p, i in zip(own, ids, strict=True) if i is None)
        self._learn(missing)
        return [
            b"".join(map(get, own)) if None in ids else b"".join(ids)
            for own, ids in zip(docs, known, strict=True)
        ]

    def decode(self, docs: list[bytes]) -> list[bytes]:
        """Bytes of each document. A query's answer lies in the order of the tokens, so its column of
        bytes is their text; where each document's tokens begin and end tells its share."""
        ids = np.frombuffer(b"".join(docs), "<u4").astype(np.int32)
        ends = np.cumsum(np.fromiter((len(d) // 4 for d in docs), np.int64, len(docs)))
        out = [[] for _ in docs]
        for start in range(0, len(ids), DECODE_ROWS):
            part = ids[start : start + DECODE_ROWS]
            self._table("tokens", pos=np.arange(len(part), dtype=np.int32), id=part)
            found = self.db.sql(DECODE).to_arrow_table().column("body").combine_chunks()
            if len(found) != len(part):
                raise ValueError("an id is not in the vocabulary")
            body = found.buffers()[2].to_pybytes() if found.buffers()[2] else b""
            spots = np.frombuffer(found.buffers()[1], np.int32)[found.offset :][: len(part) + 1]
            # Documents with tokens in this part, and where each ends in it.
            first, last = np.searchsorted(ends, [start, start + len(part) - 1], "right")
            begin = int(spots[0])
            for i in range(first, last + 1):
                end = int(spots[min(int(ends[i]) - start, len(part))])
                out[i].append(body[begin:end])
                begin = end
        return list(map(b"".join, out))


def _rows(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _slices(batches: Iterator[pa.RecordBatch], weight, most: int) -> Iterator[list[tuple]]:
    """Rows in groups of about ``most`` by weight; a batch is turned into objects piece by piece."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            columns = [c.to_pylist() for c in batch.slice(start, 512).columns]
            for row in zip(*columns, strict=True):
                held.append(row)
                size += weight(row)
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _encoder(ranks: bytes, pattern: str):
    names, types = ["doc_id", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split = Coder.of(ranks), regex.compile(pattern).findall
        for held in _slices(batches, lambda row: len(row[1] or ""), BATCH):
            packed = coder.encode([split(body or "") for _, body in held])
            rows = [(doc, len(ids) // 4, ids) for (doc, _), ids in zip(held, packed, strict=True)]
            yield _rows(names, types, rows)

    return run


def _decoder(ranks: bytes):
    names = ["doc_id", "n_tokens", "ids", "decoded"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks)
        for held in _slices(batches, lambda row: row[1] or 0, DECODE_ROWS):
            bodies = coder.decode([ids or b"" for _, _, ids in held])
            yield _rows(names, types, [(*h, b) for h, b in zip(held, bodies, strict=True)])

    return run


def _task(ranks: bytes, run):
    """``run`` over a task, which ends the worker's database at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        Coder.of(ranks).close()

    return tidy(task)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    importable(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (packed as little-endian unsigned 32-bit integers).

    Whole texts, without special tokens; a null text is empty and has no ids. Each row is a
    document of its own, whatever ids repeat; other columns are ignored.
    """
    rows = _texts(docs, doc_id, text)
    return rows.mapInArrow(_task(ranks, _encoder(ranks, pattern)), "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Rows of ``encode`` with ``decoded``, the bytes that the ids stand for."""
    importable(encoded.sparkSession)
    shape = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_task(ranks, _decoder(ranks)), shape)


def round_trip(
    docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``decode(encode(docs))`` in one worker, which then holds one vocabulary."""
    encoder, decoder = _encoder(ranks, pattern), _decoder(ranks)
    shape = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
    both = _task(ranks, lambda batches: decoder(encoder(batches)))
    return _texts(docs, doc_id, text).mapInArrow(both, shape)
