"""A Merkle manifest of a table, with proofs made by octopus multiproofs.

Leaves are digests of rows. Those of a source, ascending by id, are folded sixteen at a time into
one subroot; the subroots, ascending by source, into the root. A node is addressed by its tree (the
rank of its source, ``TOP`` for the tree of subroots), level and position, and every level is built by
one aggregation over groups of at most sixteen.

Proofs are made by leaf partition, a run of up to ``SPAN`` consecutive leaves. A partition works
out the least set of coordinates that its proofs need and its own leaves do not give (level by level
the children of the parents met, without those known), fetches these nodes in one join, derives the
inner nodes that its proofs share once, and expands every single proof from them locally. So a
partition of a million-leaf source fetches a few dozen nodes for thousands of proofs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace, running

ARITY = 16
SPAN = ARITY**3
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(columns: Iterable[str | Column]) -> Column:
    """SHA-256 (hex) of a row: ``-`` for a null, else byte count, a colon and the value."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def coordinates(positions: Iterable[int], width: int, arity: int = ARITY, level: int = 0) -> list[tuple[int, int]]:
    """The octopus: the least (level, position) pairs that, with the nodes at ``positions`` of a level
    of ``width`` nodes, give every proof of these nodes up to the root of their tree."""
    known, missing = set(positions), []
    while width > 1:
        parents = {p // arity for p in known}
        for parent in sorted(parents):
            for child in range(parent * arity, min((parent + 1) * arity, width)):
                if child not in known:
                    missing.append((level, child))
        known, width, level = parents, -(-width // arity), level + 1
    return missing


def derive(nodes: dict[tuple[int, int], str], positions: Iterable[int], width: int, arity: int = ARITY) -> str:
    """Fill ``nodes`` with the parents of the given leaves up to the root, which is returned."""
    known, level = set(positions), 0
    while width > 1:
        known = {p // arity for p in known}
        for parent in known:
            run = range(parent * arity, min((parent + 1) * arity, width))
            nodes[level + 1, parent] = digest(nodes[level, child] for child in run)
        width, level = -(-width // arity), level + 1
    return nodes[level, 0]


def siblings(nodes: dict[tuple[int, int], str], position: int, width: int, arity: int = ARITY) -> list[tuple[list[str], list[str]]]:
    """The proof of one leaf: the siblings left and right of its path, level by level."""
    path, level = [], 0
    while width > 1:
        first = position // arity * arity
        last = min(first + arity, width)
        path.append((
            [nodes[level, p] for p in range(first, position)],
            [nodes[level, p] for p in range(position + 1, last)],
        ))
        position, width, level = position // arity, -(-width // arity), level + 1
    return path


def fold(leaf: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest([*left, leaf, *right])
    return leaf


class Manifest:
    """The trees over a table of leaves (``tree``, ``pos``, ``leaf``, ``width``, ...).

    ``nodes`` holds every node above the leaves and the subroots as leaves of the tree ``TOP``.
    """

    def __init__(self, work: Workspace, leaves: DataFrame):
        self.work, self.leaves = work, leaves
        lowest = leaves.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"), "width")
        tables, subroots = self._levels(lowest, "tree")
        self.n_trees = subroots.count()
        # A lone tree is its own root; its subroot is then the only leaf of the top tree.
        lowest = subroots.select(
            F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), "digest",
            F.lit(self.n_trees).cast("bigint").alias("width"),
        )
        lowest = work.save(lowest, "top-0")
        above, roots = self._levels(lowest, "top")
        self.nodes = lowest
        for table in [*tables, *above]:
            self.nodes = self.nodes.unionByName(table)
        found = roots.select("digest").first()
        self.root = found.digest if found else None

    def _levels(self, level: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
        """Levels above the given one, of all trees at once, and the last node of each tree."""
        tables, ends, turn = [], None, 0
        while True:
            done = level.filter("width <= 1").select("tree", "digest")
            ends = done if ends is None else ends.unionByName(done)
            if level.filter("width > 1").isEmpty():
                return tables, ends
            turn += 1
            run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
            folded = (
                level.filter("width > 1")
                .groupBy("tree", F.floor(F.col("pos") / ARITY).alias("pos"), F.ceil(F.col("width") / ARITY).alias("width"))
                .agg(F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))
            )
            level = self.work.save(folded.select("tree", F.lit(turn).alias("level"), "pos", "digest", "width"), f"{name}-{turn}")
            tables.append(level)

    def requests(self, wanted: DataFrame) -> DataFrame:
        """``part`` and the coordinates (``at``, ``level``, ``pos``) that each leaf partition must fetch."""
        n_trees = self.n_trees

        def missing(part: pd.DataFrame) -> pd.DataFrame:
            number, need = int(part.part.iat[0]), []
            for tree, rows in part.groupby("tree"):
                need += [(tree, *c) for c in coordinates(rows.pos.tolist(), int(rows.width.iat[0]))]
            need += [(TOP, *c) for c in coordinates(part.tree.tolist(), n_trees)]
            frame = pd.DataFrame(need, columns=["at", "level", "pos"])
            frame.insert(0, "part", number)
            return frame

        placed = wanted.select("part", "tree", "pos", "width")
        return placed.groupBy("part").applyInPandas(missing, "part long, at long, level int, pos long")

    def prove(self, wanted: DataFrame | None = None) -> DataFrame:
        """Proofs of the wanted leaves (rows of ``leaves``; all of them by default), checked against the
        root: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``.

        A leaf is folded from ``shown`` where it is not null: what a receiver holds.
        """
        nodes = self.nodes
        if wanted is not None:
            # Leaves that are not asked for are somebody's siblings.
            nodes = nodes.unionByName(
                self.leaves.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"), "width")
            )
        wanted = self.leaves if wanted is None else wanted
        asked = self.work.save(self.requests(wanted), "requests")
        fetched = asked.join(
            nodes.select(F.col("tree").alias("at"), "level", "pos", "digest"), ["at", "level", "pos"]
        )
        n_trees, root = self.n_trees, self.root

        def expand(part: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            held: dict[int, dict[tuple[int, int], str]] = defaultdict(dict)
            for at, level, pos, value in zip(given["at"], given["level"], given["pos"], given["digest"], strict=True):
                held[at][level, pos] = value
            top, done = held[TOP], []
            trees = list(part.groupby("tree"))
            for tree, rows in trees:
                held[tree].update(((0, p), leaf) for p, leaf in zip(rows.pos, rows.leaf, strict=True))
                top[0, tree] = derive(held[tree], rows.pos.tolist(), int(rows.width.iat[0]))
            if trees and derive(top, [tree for tree, _ in trees], n_trees) != root:
                raise ValueError("the fetched nodes do not give the root")
            for tree, rows in trees:
                width, upper = int(rows.width.iat[0]), siblings(top, tree, n_trees)
                proofs, folded = [], []
                for pos, leaf, shown in zip(rows.pos, rows.leaf, rows.shown, strict=True):
                    path = siblings(held[tree], pos, width) + upper
                    proofs.append(digest(d for left, right in path for d in (*left, *right)))
                    folded.append(fold(shown if isinstance(shown, str) else leaf, path))
                done.append(pd.DataFrame({
                    "doc_id": rows.doc_id.astype("Int64"), "leaf": rows.leaf, "subroot": top[0, tree], "root": root,
                    "proof_sha256": proofs, "folded_root": folded,
                }))
            columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            return pd.concat(done) if done else pd.DataFrame(columns=columns)

        return wanted.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(
            expand, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        )


def place_leaves(work: Workspace, leaves: DataFrame) -> DataFrame:
    """Give leaves (``source``, ``doc_id``, ``leaf``, ``shown``) their tree, position and leaf partition.

    Ranks are range-partitioned, so a source may hold any share of the rows. Partitions are runs of
    consecutive leaves of at most ``SPAN``, across sources, that never cut a group of siblings.
    """
    placed = work.save(running(work, "ranked", leaves, ["source"], ["doc_id", "leaf"], into="pos"), "placed")
    sources = placed.groupBy("source").agg(F.count("*").alias("width"))
    sources = sources.withColumns({"all": F.lit(0), "runs": F.ceil(F.col("width") / ARITY)})
    sources = running(work, "trees", sources, ["all"], ["source"], into="tree")
    sources = running(work, "offsets", sources, ["all"], ["source"], "runs", "offset")
    sources = work.save(sources.select("source", "width", "tree", "offset"), "sources")
    run = F.col("offset") + F.floor(F.col("pos") / ARITY)
    joined = placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    return joined.select(
        "tree", "pos", "width", F.floor(run / (SPAN // ARITY)).alias("part"), "doc_id", "leaf", "shown"
    )


def merkle_manifest(
    docs: DataFrame,
    columns: Iterable[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    shown: Column | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
) -> Manifest:
    """The manifest of ``docs``: one tree per source (null first), leaves ascending by id.

    A leaf covers the given columns; others are ignored. Null ids come first; rows of one source and
    id are ordered by their leaves, and equal rows are leaves of their own. ``shown`` is what a receiver
    holds in place of a leaf (null: the leaf itself). An empty table has no root and no proofs.
    """
    work = Workspace(docs.sparkSession, "manifest")
    leaves = docs.select(
        F.col(source).alias("source"),
        F.col(doc_id).cast("bigint").alias("doc_id"),
        row_digest(columns).alias("leaf"),
        (F.lit(None).cast("string") if shown is None else shown).alias("shown"),
    )
    return Manifest(work, work.save(place_leaves(work, leaves), "leaves"))


def verify_tampered(docs: DataFrame, every: int = 5) -> DataFrame:
    """All proofs of ``docs``, checked against rows of which every fifth (by the CRC-32 of its id) may
    come with its text in lower case (A-Z; a null text or id is left alone).

    The columns of ``Manifest.prove`` and ``verified``.
    """
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    lowered = F.translate("text", UPPER, LOWER)
    shown = F.when(tampered, row_digest(["doc_id", "source", "lang", "n_chars", lowered]))
    proofs = merkle_manifest(docs, shown=shown).prove()
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
