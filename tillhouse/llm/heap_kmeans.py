"""Exact integer k-means whose vectors wait in heaps until their bounds expire.

Each block of vectors keeps one heap per cluster. An entry's key is the vector's gap, the distance to
the second nearest centroid less that to its own, plus the drift that the cluster had accumulated
when the entry was made. A round adds to a cluster's drift how far its centroid moved and the most that
another moved: the gap can have shrunk by no more. So only entries whose key is not above the
cluster's drift are popped; these vectors are compared with all centroids in whole numbers, and
their entries made anew. All others stay where they are, unread.

Assignments are exact, ties included: keys are lowered by more than the rounding of the square roots, so a
vector in doubt is always compared. Centroids follow from the sums of the vectors that changed
cluster, whole numbers as well, so neither blocks nor retried tasks change the result.

A block is one row: ids, vectors and heaps of up to ``BLOCK`` vectors as packed arrays, rewritten each
round as a table. Sums leave a task as one row per cluster; only centroids reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
BLOCK = 4096
# Squared distances of 64 components below this in magnitude fit a signed 64-bit number.
MOST = 1 << 27
# More than the relative error of a difference of two square roots.
SLACK = 1e-12

BLOCK_SHAPE = (
    "ids array<bigint>, vectors binary, cluster binary, keys binary, members binary, "
    "distance binary, popped bigint, sums binary, counts binary"
)
NAMES = [part.split()[0] for part in BLOCK_SHAPE.split(", ")]


@dataclass
class Block:
    """Vectors of one row and the heaps over them. ``heaps[c]`` holds (key, member) of cluster c."""

    vectors: np.ndarray
    cluster: np.ndarray
    heaps: list[list[tuple[float, int]]]

    @classmethod
    def fresh(cls, vectors: np.ndarray, clusters: int) -> Block:
        """No vector has a cluster: all are entries of no heap yet."""
        return cls(vectors, np.full(len(vectors), -1, np.int16), [[] for _ in range(clusters)])

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Bring every vector to its nearest centroid. Returns the changes of the clusters' sums and
        counts, and how many vectors were compared."""
        expired = list(np.flatnonzero(self.cluster < 0))
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                expired.append(heapq.heappop(heap)[1])
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        if not expired:
            return sums, counts, 0
        at = np.array(expired)
        vectors = self.vectors[at]
        squared = distances(vectors, centroids)
        new, old = squared.argmin(1), self.cluster[at]
        nearest = np.sqrt(np.partition(squared, min(1, len(centroids) - 1), 1)[:, :2].astype(np.float64))
        gap = nearest[:, 1] - nearest[:, 0] if len(centroids) > 1 else np.full(len(at), np.inf)
        reach = nearest[:, -1] + nearest[:, 0] + drift[new] + 1
        keys = gap + drift[new] - SLACK * reach
        for member, c, key in zip(expired, new.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (key, int(member)))
        moved = new != old
        np.add.at(sums, new[moved], vectors[moved])
        np.add.at(counts, new[moved], 1)
        left = moved & (old >= 0)
        np.subtract.at(sums, old[left], vectors[left])
        np.subtract.at(counts, old[left], 1)
        self.cluster[at] = new
        return sums, counts, len(expired)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, one column per centroid."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        apart = vectors - centre
        out[:, c] = np.einsum("ij,ij->i", apart, apart)
    return out


def _packed(ids: pa.Array, block: Block, centroids: np.ndarray, changed) -> pa.RecordBatch:
    sums, counts, popped = changed
    lengths = np.array([len(h) for h in block.heaps], np.int32)
    entries = [e for h in block.heaps for e in h]
    apart = block.vectors - centroids[block.cluster]
    row = [
        ids,
        block.vectors.astype(np.int32).tobytes(),
        block.cluster.tobytes(),
        np.array([k for k, _ in entries], np.float64).tobytes(),
        lengths.tobytes() + np.array([m for _, m in entries], np.int32).tobytes(),
        np.einsum("ij,ij->i", apart, apart).tobytes(),
        popped,
        sums.tobytes(),
        counts.tobytes(),
    ]
    types = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), *[pa.binary()] * 2]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], NAMES)


def _first(centroids: np.ndarray):
    """Vectors (``vec_id``, ``vector``) to blocks with a first assignment."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
                block = Block.fresh(vectors, len(centroids))
                changed = block.advance(centroids, np.zeros(len(centroids)))
                yield _packed(part.column(0).to_pylist(), block, centroids, changed)

    return run


def _next(centroids: np.ndarray, drift: np.ndarray):
    """Blocks to blocks, one round on."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, width).astype(np.int64)
                lengths = np.frombuffer(row["members"], np.int32, k)
                members = np.frombuffer(row["members"], np.int32, offset=4 * k).tolist()
                keys = np.frombuffer(row["keys"], np.float64).tolist()
                ends = np.append(0, np.cumsum(lengths)).tolist()
                heaps = [list(zip(keys[a:b], members[a:b], strict=True)) for a, b in zip(ends, ends[1:], strict=False)]
                block = Block(vectors, np.frombuffer(row["cluster"], np.int16).copy(), heaps)
                changed = block.advance(centroids, drift)
                yield _packed(row["ids"], block, centroids, changed)

    return run


def _per_task(k: int, width: int):
    """Changes of all blocks of a task: one row per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for total, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums += np.frombuffer(total, np.int64).reshape(k, width)
                counts += np.frombuffer(many, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))],
            ["cluster", "count", "sums"],
        )

    return run


def _changes(blocks: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of the clusters' sums and counts over all blocks: one row per cluster and component."""
    partial = blocks.select("sums", "counts").mapInArrow(_per_task(k, width), "cluster int, count bigint, sums array<bigint>")
    rows = partial.select("cluster", "count", F.posexplode("sums").alias("i", "x"))
    sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for r in rows.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("count").alias("n")).collect():
        sums[r.cluster, r.i], counts[r.cluster] = r.x, r.n
    return sums, counts


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, cluster, distance in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.frombuffer(cluster, np.int16).astype(np.int32)),
                    pa.array(np.frombuffer(distance, np.int64)),
                ],
                ["vec_id", "cluster", "distance"],
            )


def integer_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """``vec_id`` and ``vector`` (array of bigint) of the rows with exactly ``size`` components, all finite."""
    value = F.col(embedding)
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * scale))
    fits = lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < MOST)  # noqa: E731 (also false for NaN)
    return vectors.filter((F.size(value) == size) & F.forall(value, fits)).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("vector")
    )


def heap_kmeans(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = 1,
    size: int = DIMENSIONS,
    scale: int = SCALE,
    log: list[int] | None = None,
) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``,
    ``inertia``, ``centroid_sha256``.

    Vectors that are null, of another length, or hold a null or non-finite component are left out, and so
    are those with a component of 2^27 / ``scale`` or more in magnitude, whose distances no long
    holds. Ids may be null or repeat: rows are vectors of their own, a null id is hashed as an empty
    one, and equal ids are seeded in the order of their vectors. With fewer vectors than clusters
    each is a centroid; an empty table gives none. Other columns are ignored. Into ``log`` goes the number of
    vectors that each round compared.
    """
    work = Workspace(vectors.sparkSession, "heap-kmeans")
    whole = integer_vectors(vectors, vec_id, embedding, size, scale)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    seeds = whole.select("vector", F.sha2(name, 256).alias("hash")).orderBy("hash", "vector").limit(clusters).collect()
    if not seeds:
        shape = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], shape)
    centroids = np.array([r.vector for r in seeds], np.int64)
    k = len(centroids)
    drift = np.zeros(k)
    sums, counts = np.zeros_like(centroids), np.zeros(k, np.int64)
    blocks = work.save(whole.mapInArrow(_first(centroids), BLOCK_SHAPE), "round-0")
    for turn in range(1, rounds + 1):
        more, n = _changes(blocks, k, size)
        sums, counts = sums + more, counts + n
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        step = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        # The most that any other centroid moved.
        others = np.array([np.delete(step, c).max(initial=0.0) for c in range(k)])
        drift, centroids = (drift + step + others) * (1 + SLACK), new
        blocks = work.save(blocks.mapInArrow(_next(centroids, drift), BLOCK_SHAPE), f"round-{turn}")
        work.drop(f"round-{turn - 1}")
    if log is not None:
        log.append(blocks.agg(F.sum("popped").alias("n")).first().n)
    found = work.save(
        blocks.select("ids", "cluster", "distance").mapInArrow(_unpack, "vec_id bigint, cluster int, distance bigint"), "found"
    )
    per_cluster = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    # At most one row per cluster: a bounded broadcast.
    facts = vectors.sparkSession.createDataFrame(
        [
            (c, int(per_cluster.get(c, 0)), int(sum(per_cluster.values())), ",".join(map(str, centroids[c].tolist())))
            for c in range(k)
        ],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )
