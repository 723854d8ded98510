"""Near-duplicate vectors: spherical k-means cells, cosine products between blocks of cells.

Vectors are compared only with vectors of the same label. Equal vectors are one class first, so a
hot vector costs one row. Spherical k-means, fitted per label on a bounded sample, gives each
class a home cell. Two vectors that link differ by at most the chord of the threshold, in any
direction; so of two cells only those rows meet whose distances from the plane between the cells
add up to no more than that. Products are taken over half of the components first, which with what is
left of the norms bounds the whole, in single precision, and again in double where its rounding could decide.

A label that fits a block is compared in one task. The cells of a larger one are packed into
blocks, each written once as one row of a file; a task reads the two blocks that it compares, so
pairs of blocks are neither shuffled nor written and disk follows the number of vectors. A
crowded cell is many blocks, so many tasks, none of them large.

No link is missed. The price depends on the vectors: those that lie in clusters meet few rows of
other cells, those spread evenly over all directions meet a share of most. ``probes`` bounds the
cells that a vector visits for such data; then a link is missed if neither vector visits the
other's home.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tillhouse.llm.components import components
from tillhouse.llm.workspace import Workspace, tidy

COSINE = 0.93
CELL_ROWS = 1_024  # classes that a cell is meant for
MOST_CELLS = 1_024  # of a label
BLOCK_BYTES = 8 << 20  # of the vectors that a block is meant for
STRIPE_BLOCKS = 8  # of a label, in one folder
JOB_STRIPES = 16  # pairs of stripes that are compared in one job
SAMPLE = 40  # vectors per cell that k-means is fitted on
ROUNDS = 12
TILE_ROWS, TILE_COLUMNS = 256, 2_048  # of products that are held at once
OPEN_EDGES = 100_000  # of a task, before they are joined up

FOUND = "a bigint, b bigint, n bigint"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors. An empty cell takes the vector that fits its own worst."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(1))[: len(empty)]]
        centres = _unit(sums)
    return centres


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their components."""
    for batch in batches:
        vectors = batch.column("vector")
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.asarray(vectors.offsets)
        ends = ((ends - ends[0]) * flat.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], ["vec_id", "label", "vector"])


def _matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)


def _fit_label(kind: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Centroids, and the share of a label that lies in the cells before each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(_matrix(pdf["vector"].tolist(), kind).astype(float))
        x = x[np.lexsort(x.T[::-1])]
        centres = spherical_kmeans(x, max(1, min(int(pdf["cells"].iloc[0]), len(x))))
        rows = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
        shares = np.concatenate([[0], np.cumsum(rows) / len(x)])
        found = {"label": pdf["label"].iloc[0], "centres": centres.astype("<f4").tobytes(), "shares": shares.tobytes()}
        return pd.DataFrame([found])

    return run


def _centres(centres: bytes | None, width: int) -> np.ndarray:
    """A label that the sample lacks has one cell, around nothing."""
    return np.zeros((1, width), "<f4") if centres is None else np.frombuffer(centres, "<f4").reshape(-1, width)


def _homes(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    steps = range(0, len(unit), 4_096)
    return np.concatenate([(unit[i : i + 4_096] @ centres.T).argmax(1) for i in steps]).astype(np.int32)


class _Block(NamedTuple):
    """Classes in the order of their cells."""

    ids: np.ndarray
    members: np.ndarray
    cells: np.ndarray
    vectors: np.ndarray
    norm: np.ndarray
    unit: np.ndarray  # single precision
    head: np.ndarray  # half of the unit, and the norm of the rest: its products are no less than those of units

    @staticmethod
    def of(ids: np.ndarray, members: np.ndarray, cells: np.ndarray, vectors: np.ndarray) -> _Block:
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=float))
        unit = (vectors / norm[:, None]).astype("<f4")
        half = -(-unit.shape[1] // 2)
        rest = np.sqrt(np.einsum("ij,ij->i", unit[:, half:], unit[:, half:]))
        return _Block(ids, members, cells, vectors, norm, unit, np.column_stack([unit[:, :half], rest]))

    def exact(self, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(float) / self.norm[rows, None]


def _of_label(kind: str, cosine: float, probes: int | None):
    """Links of a label that one task compares."""

    def run(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _found(((), (), ()))
        vectors = _matrix(rows["vector"].to_pylist(), kind)
        centres = _centres(fitted["centres"][0].as_py(), vectors.shape[1])
        block = _Block.of(rows["class_id"].to_numpy(), rows["members"].to_numpy(), np.zeros(0), vectors)
        cells = _homes(block.unit, centres)
        order = np.argsort(cells, kind="stable")
        block = _Block(*(x[order] for x in block._replace(cells=cells)))
        return _found(_compare(block, block, centres, cosine, probes))

    return run


def _places(kind: str):
    """Home cell of each row, and the block that its place in the cell belongs to."""

    def run(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        block, cell = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if rows.num_rows:
            vectors = _matrix(rows["vector"].to_pylist(), kind)
            centres = _centres(fitted["centres"][0].as_py(), vectors.shape[1])
            cell = _homes(_unit(vectors.astype(float)).astype("<f4"), centres)
            shares, blocks = fitted["shares"][0].as_py(), fitted["blocks"][0].as_py()
            shares = np.array([0.0, 1.0]) if shares is None else np.frombuffer(shares)
            spot = pd.util.hash_array(rows["class_id"].to_numpy()) / 2.0**64
            at = shares[cell] + spot * (shares[cell + 1] - shares[cell])
            block = np.minimum(at * blocks, blocks - 1).astype(np.int32)
        taken = rows.select(["label", "class_id", "members", "vector"])
        return taken.append_column("block", pa.array(block)).append_column("cell", pa.array(cell))

    return run


def _block(rows: pa.Table, fitted: pa.Table) -> pa.Table:
    """A block as one row, with all centroids of its label."""
    given = fitted.select(["stripe", "label", "block", "centres"])
    if not rows.num_rows:
        given = given.slice(0, 0)
    rows = rows.sort_by([("cell", "ascending"), ("class_id", "ascending")])
    packed = {c: rows[c].to_numpy().tobytes() for c in ("class_id", "members", "cell")}
    packed["vector"] = b"".join(rows["vector"].to_pylist())
    for c, value in packed.items():
        given = given.append_column(c, pa.array([value] * given.num_rows, pa.binary()))
    return given


BLOCK = "stripe int, label string, block int, centres binary, class_id binary, members binary, cell binary, vector binary"
PARTS = ["block", "class_id", "members", "cell", "vector"]


def _of_blocks(kind: str, cosine: float, probes: int | None):
    """Links between the blocks ``a`` and ``b`` of each row."""

    def read(row: dict, side: str) -> _Block:
        ids, members = (np.frombuffer(row[f"{side}_{c}"].as_buffer(), np.int64) for c in ("class_id", "members"))
        cells = np.frombuffer(row[f"{side}_cell"].as_buffer(), np.int32)
        vectors = np.frombuffer(row[f"{side}_vector"].as_buffer(), kind).reshape(len(ids), -1)
        return _Block.of(ids, members, cells, vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                a = read(row, "a")
                b = a if row["a_block"] == row["b_block"] else read(row, "b")
                centres = _centres(row["centres"].as_py(), a.vectors.shape[1])
                yield from _found(_compare(a, b, centres, cosine, probes)).to_batches()

    return run


def _found(columns: tuple) -> pa.Table:
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip("abn", columns, strict=True)})


def _join_up(least: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``least`` has a node's least connected one; returns it with the links from ``u`` to ``v`` added."""
    while True:
        a, b = least[u], least[v]
        if (a == b).all():
            return least
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while ((up := least[least]) != least).any():
            least = up


def _compare(x: _Block, y: _Block, centres: np.ndarray, cosine: float, probes: int | None) -> tuple[np.ndarray, ...]:
    """Every linked class of two blocks (or of one, if ``x`` is ``y``), a class that it is connected to
    here, and the number of vectors that it links with here."""
    same = x is y
    shift = 0 if same else len(x.ids)
    ids = x.ids if same else np.concatenate([x.ids, y.ids])
    links, least = np.zeros(len(ids), np.int64), np.arange(len(ids))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    plain = x.members.max() == 1 and y.members.max() == 1
    slack = (x.unit.shape[1] + 8) * 2.0**-23  # above the rounding of a product
    tried = cut = 0

    def tile(rows: np.ndarray, columns: np.ndarray, u: np.ndarray, v: np.ndarray, square: bool = False) -> None:
        """u, v: their heads. square: rows and columns are the same."""
        nonlocal least, tried, cut
        if cut * 2 >= tried - TILE_ROWS:  # else heads seldom decide here
            tried += 1
            if (u @ v.T).max() < cosine - slack:
                cut += 1
                return
        near = x.unit[rows] @ y.unit[columns].T
        if near.max() < cosine - slack:
            return
        linked = near >= cosine + slack
        close = (near >= cosine - slack) ^ linked
        if close.any():
            i, j = np.nonzero(close)
            for k in range(0, len(i), TILE_COLUMNS):
                p, q = i[k : k + TILE_COLUMNS], j[k : k + TILE_COLUMNS]
                linked[p, q] = (x.exact(rows[p]) * y.exact(columns[q])).sum(1) >= cosine
        i, j = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        rows, columns = rows[i], columns[j]
        linked = linked[np.ix_(i, j)] & (x.ids[rows][:, None] != y.ids[columns])
        if not linked.any():
            return
        columns_at = shift + columns
        if plain:
            links[rows] += np.count_nonzero(linked, 1)
        else:
            links[rows] += (linked @ y.members[columns].astype(float)).astype(np.int64)
        if not square:
            if plain:
                links[columns_at] += np.count_nonzero(linked, 0)
            else:
                links[columns_at] += (x.members[rows].astype(float) @ linked).astype(np.int64)
        ends = np.concatenate([rows, columns_at])
        if (least[ends] == least[ends[0]]).all():
            return
        # Every part that has a link to another joins up with one of these, until none has.
        own = np.arange(len(ends))
        while True:
            apart = linked & (own[: len(rows)][:, None] != own[len(rows) :])
            i, j = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
            if not len(i):
                break
            first, second = apart[i].argmax(1), apart[:, j].argmax(0)
            own = _join_up(own, np.concatenate([i, second]), len(rows) + np.concatenate([first, j]))
        edges.append((ends, ends[own]))
        if sum(len(e) for e, _ in edges) > OPEN_EDGES:
            least = _join_up(least, *map(np.concatenate, zip(*edges, strict=True)))
            edges.clear()

    def meet(rows: np.ndarray, columns: np.ndarray, ends: np.ndarray | None = None) -> None:
        """ends: how many of the columns each row meets, if not all; never more than the row before it."""
        u, v = x.head[rows], y.head[columns]
        for r in range(0, len(rows), TILE_ROWS):
            some = slice(r, r + TILE_ROWS)
            end = len(columns) if ends is None else ends[r]
            for c in range(0, end, TILE_COLUMNS):
                others = slice(c, min(c + TILE_COLUMNS, end))
                tile(rows[some], columns[others], u[some], v[others])

    def meet_itself(rows: np.ndarray) -> None:
        u = x.head[rows]
        for r in range(0, len(rows), TILE_ROWS):
            some = slice(r, r + TILE_ROWS)
            tile(rows[some], rows[some], u[some], u[some], True)
            for c in range(r + TILE_ROWS, len(rows), TILE_COLUMNS):
                others = slice(c, c + TILE_COLUMNS)
                tile(rows[some], rows[others], u[some], u[others])

    def spans(cells: np.ndarray) -> list[tuple[int, int, int]]:
        found, starts = np.unique(cells, return_index=True)
        return list(zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True))

    of_x, of_y = spans(x.cells), spans(y.cells)

    def beyond(block: _Block, others: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray | None]:
        """By how much a row is nearer to its own centroid than to each other one; whether it visits that."""
        at = [c for c, *_ in others]
        own = np.einsum("ij,ij->i", block.unit, centres[block.cells])
        near = block.unit @ centres[at].T
        if probes is None or probes >= len(centres):
            return own[:, None] - near, None
        visits = np.zeros(near.shape, bool)
        for r in range(0, len(near), TILE_ROWS):
            every = block.unit[r : r + TILE_ROWS] @ centres.T
            least_near = np.partition(every, len(centres) - probes, 1)[:, len(centres) - probes]
            visits[r : r + TILE_ROWS] = every[:, at] >= least_near[:, None]
        return own[:, None] - near, visits

    gap_x, visits_x = beyond(x, of_y)
    gap_y, visits_y = (gap_x, visits_x) if same else beyond(y, of_x)
    least_x = np.minimum.reduceat(gap_x, [s for _, s, _ in of_x])
    least_y = np.minimum.reduceat(gap_y, [s for _, s, _ in of_y])
    exact = centres.astype(float)
    for p, (a, start, end) in enumerate(of_x):
        # A row is as far from the plane between two cells as its gap over the distance of their centroids.
        most = np.sqrt(2 - 2 * cosine) * np.linalg.norm(exact[[c for c, *_ in of_y]] - exact[a], axis=1) + 4 * slack
        for q in np.flatnonzero(least_x[p] + least_y[:, p] <= most):
            b, begin, stop = of_y[q]
            if same and q < p:
                continue
            if a == b:
                rows = np.arange(start, end)
                if same:
                    meet_itself(rows)
                else:
                    meet(rows, np.arange(begin, stop))
                continue
            g, h = gap_x[start:end, q], gap_y[begin:stop, p]
            rows, columns = np.flatnonzero(g <= most[q] - least_y[q, p]), np.flatnonzero(h <= most[q] - least_x[p, q])
            rows, columns = rows[g[rows].argsort()], columns[h[columns].argsort()]
            room = np.searchsorted(h[columns], most[q] - g[rows], "right")
            if visits_x is None:
                meet(start + rows, begin + columns, room)
                continue
            visits, visited = visits_x[start + rows, q], visits_y[begin + columns, p]
            meet(start + rows[visits], begin + columns, room[visits])
            meet(start + rows[~visits], begin + columns[visited], np.cumsum([0, *visited])[room[~visits]])
    if edges:
        least = _join_up(least, *map(np.concatenate, zip(*edges, strict=True)))
    at = np.flatnonzero(links)
    return ids[at], ids[least[at]], links[at]


def embedding_dedup(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    cell_rows: int = CELL_ROWS,
    probes: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``, one row per row of ``vectors``.

    Null or zero vectors, vectors with null or non-finite components, and vectors without a label
    link with nothing and stay. Vectors of different length never link. Rows that repeat an id
    are vectors of their own. Rows without an id are not compared; their component is null.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embedding-dedup", keep_shuffles=False)
    double = F.col(embedding).cast("array<double>")
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x))
    given = vectors.select(embedding).schema[0].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(label).alias("group"),
        (F.col(embedding) if single else double).alias("vector"),
        norm.alias("norm"),
    )
    # The norm, which is null where a component is, comes up once only: a filter works it out each time.
    sound = F.exists(F.array("norm"), lambda n: (n > 0) & (n < float("inf")) & ~F.isnan(n))
    usable = F.col("vec_id").isNotNull() & F.col("group").isNotNull() & sound
    # Vectors of another length are another label, so to speak.
    named = F.concat_ws(":", F.col("group").cast("string"), F.size("vector").cast("string"))
    ok = rows.filter(usable).select("vec_id", named.alias("label"), "vector")
    ok = ok.mapInArrow(tidy(_pack), "vec_id bigint, label string, vector binary")
    classes = ok.groupBy("label", "vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members"))
    classes = work.save(classes, "classes")
    digest = F.unhex(F.sha2("vector", 256)).alias("digest")
    copied = work.save(
        classes.filter("members > 1").select("label", digest, F.col("class_id").alias("copy_of"), "members"), "copied"
    )

    # k-means per label on a sample by hash of the id.
    per_label = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.octet_length("vector")).alias("width"))
    cells = F.least(F.ceil(F.col("n") / cell_rows), F.lit(MOST_CELLS)).cast("int")
    blocks = F.ceil(F.col("n") * F.col("width") / block_bytes).cast("int")
    plan = work.save(per_label.withColumns({"cells": cells, "blocks": blocks}), "plan")
    share = F.col("cells") * SAMPLE / F.col("n")
    drawn = F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(1 << 30)) < F.greatest(share, 64 / F.col("n")) * (1 << 30)
    sample = classes.join(plan, "label").filter(drawn).select("label", "cells", "vector")
    centres = work.save(
        sample.groupBy("label").applyInPandas(_fit_label(kind), "label string, centres binary, shares binary"), "centres"
    )

    # A label of one block is one task.
    own = plan.filter("blocks = 1 AND n > 1").select("label").join(centres, "label", "left")
    small = classes.join(own.select("label"), "label", "left_semi")
    found = small.groupBy("label").cogroup(own.groupBy("label")).applyInArrow(_of_label(kind, cosine, probes), FOUND)
    work.save(found, "found/job=0")

    # Larger ones, of which there are few, in stripes of blocks that a task can read without the others.
    large, stripes, pairs = [], 0, []
    for r in plan.filter("blocks > 1").select("label", "blocks").orderBy("label").collect():
        large.append((r.label, r.blocks, stripes))
        first, stripes = stripes, stripes - (-r.blocks // STRIPE_BLOCKS)
        pairs += [(a, b) for a in range(first, stripes) for b in range(a, stripes)]
    if large:
        of = spark.createDataFrame(large, "label string, blocks int, stripes_before int")
        of = work.save(of.join(centres, "label", "left"), "large")
        # Vectors of a label are dealt into groups that a task holds; each gets the label's centres once.
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        slot = F.pmod(F.xxhash64("class_id", F.lit(4)), F.col("blocks")).cast("int").alias("slot")
        dealt = classes.join(of.select("label", "blocks"), "label").select(*classes.columns, slot)
        placed = dealt.groupBy("label", "slot").cogroup(of.select("*", every.alias("slot")).groupBy("label", "slot"))
        placed = work.save(
            placed.applyInArrow(_places(kind), "label string, class_id bigint, members bigint, vector binary, block int, cell int"),
            "placed",
        )
        work.drop("classes")
        stripe = (F.col("stripes_before") + F.floor(F.col("block") / STRIPE_BLOCKS)).cast("int").alias("stripe")
        blocks = of.select("label", "centres", "stripes_before", every.alias("block")).select("*", stripe)
        packed = placed.groupBy("label", "block").cogroup(blocks.groupBy("label", "block")).applyInArrow(_block, BLOCK)
        # A file of its own each, or else a reader's batch would hold many of them.
        packed = work.save(packed, "blocks", by="stripe", file_rows=1)
        work.drop("placed")
        side = lambda name, at, *more: packed.filter(F.col("stripe") == at).select(
            *[F.col(c).alias(f"{name}_{c}") for c in PARTS], *more
        )
        for job in range(0, len(pairs), JOB_STRIPES):
            # Each task reads a few files of either side: nothing is shuffled.
            met = [
                side("a", a, "centres").hint("shuffle_replicate_nl").join(side("b", b), F.col("a_block") <= F.col("b_block"))
                for a, b in pairs[job : job + JOB_STRIPES]
            ]
            found = reduce(DataFrame.unionByName, met).mapInArrow(tidy(_of_blocks(kind, cosine, probes)), FOUND)
            work.save(found, f"found/job={job + 1}")
        work.drop("blocks")
    work.drop("classes")
    found = spark.read.schema(f"{FOUND}, job int").parquet(f"{work.root}/found")
    links = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("links"))
    joined = components(work, found.filter("a <> b").select("a", "b"))
    judged = work.save(
        links.join(joined.withColumnRenamed("id", "class_id"), "class_id", "full"), "judged"
    )
    work.drop("found")
    # Rows are sought by their digest; those without copies are their class.
    member = ok.select("vec_id", "label", digest).join(copied, ["label", "digest"], "left")
    linked = member.withColumn("class_id", F.coalesce("copy_of", "vec_id")).join(judged, "class_id", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce("members", F.lit(1)) - 1).cast("bigint").alias("n_links"),
        F.coalesce("component", "class_id").alias("component_id"),
    )
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
