"""N-gram Jaccard join by grouped prefixes.

Two documents link when the sets of their five-word shingles overlap by at least 80 percent of their
union. In one fixed order of all shingles, rare ones first, linked sets share a shingle among
their first ``n - ceil(0.8 n) + 1``: their prefixes.

1. A sketch of fixed size counts all shingles; it only orders them, so its errors cost time and
   never a link.
2. Documents with equal sets are one class. Classes with equal prefixes and size are one group, and
   only groups enter the prefix index. Shingles that one group alone has are left out.
3. In each posting list every group meets the list's first group of like size, of another component
   than its own. Of these each group tries the one that it meets in the most lists, if that can
   suffice: members are expanded and verified on whole texts, and what links becomes a component.
   This is repeated until it links nothing new. Who leads a list stays the same, so the lists are gone
   through once for all rounds.
4. Posting lists that still hold several components pair them up. A parity signature of each set
   bounds the difference of two sets from below, exactly, so a pair that cannot link leaves the
   join before it is a row, and a pair is a row only where it meets early enough in both prefixes for
   the rest of them to suffice. Those that share too little of their prefixes to reach the
   threshold are left out then, the others verified.

So a large family of near copies costs one comparison each instead of one for each pair, and
every link between two components is found: the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.llm.components import components
from tillhouse.llm.rolling import BASES, chunks, mixed, run_hashes, word_hashes
from tillhouse.llm.workspace import Workspace, boxed, tidy

SHINGLE = 5
PERCENT = 80
# The sketch: counters, and the rows that they travel in.
SKETCH_BITS = 20
SKETCH_ROWS = 16
# Words of 64 bits of a set's parity signature. Sets that differ by more than a few hundred
# shingles are told apart by 256 bits; beyond that the signature only stops excluding pairs.
SIGNATURE = 4


def _least(n, percent: int = PERCENT):
    """Least overlap of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def _need(n: str, m: str, percent: int) -> Column:
    """What two sets of these sizes have to share."""
    return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent) - 1e-9)


def _rest(n: str, m: str, percent: int) -> Column:
    """The most that they can share behind the prefix of either."""
    return F.greatest(*[F.ceil(F.col(v) * percent / 100 - 1e-9) - 1 for v in (n, m)])


def _prefix(n: str, percent: int) -> Column:
    return F.col(n) - F.ceil(F.col(n) * percent / 100 - 1e-9) + 1


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, repeats included, and where each text's begin.

    A text of fewer than k words has one shingle, all its words; without words it has none.
    """
    words, bounds = word_hashes(texts, lower=True)
    count = np.diff(bounds)
    usable = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(usable)
    at = np.repeat(bounds[:-1], usable) + np.arange(ends[-1]) - np.repeat(ends - usable, usable)
    out = run_hashes(words, k, BASES[0])[at]
    short = np.flatnonzero((count > 0) & (count < k))
    for size in range(1, k):
        own = short[count[short] == size]
        if len(own):
            out[ends[own] - 1] = mixed(run_hashes(words, size, BASES[1])[bounds[own]] + np.uint64(size))
    return out, np.append(0, ends)


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for _, bodies in chunks(texts, texts):
                cells = shingles(bodies, k)[0] >> np.uint64(64 - SKETCH_BITS)
                total += np.bincount(cells.astype(np.int64), minlength=1 << SKETCH_BITS)
        context = TaskContext.get()
        yield _sketch_rows(total, context.partitionId() if context else 0)

    return run


def _sketch_rows(total: np.ndarray, task: int) -> pa.RecordBatch:
    parts = [x.tobytes() for x in total.reshape(SKETCH_ROWS, -1)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(SKETCH_ROWS), pa.int32()),
            pa.array([task] * SKETCH_ROWS, pa.int32()),
            pa.array(parts, pa.binary()),
        ],
        ["part", "task", "counts"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counters of each part that came to this task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, _, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = np.frombuffer(counts, np.int64)
            sums[part] = sums[part] + new if part in sums else new
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(sums.keys(), pa.int32()),
            pa.array([0] * len(sums), pa.int32()),
            pa.array([x.tobytes() for x in sums.values()], pa.binary()),
        ],
        ["part", "task", "counts"],
    )


def shingle_levels(texts: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """For each cell of the sketch the rounded logarithm of its count, one byte each: one MB in
    all, however many documents there are."""
    shape = "part int, task int, counts binary"
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = texts.mapInArrow(tidy(_count(k)), shape)
    # In two steps, so that no task adds up what all tasks counted.
    some = counted.repartition(tasks, "part", F.col("task") % tasks).mapInArrow(tidy(_add), shape)
    parts = some.repartition(SKETCH_ROWS, "part").mapInArrow(tidy(_add), shape).collect()
    total = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.int64)
    for row in parts:
        total[row.part] += np.frombuffer(row.counts, np.int64)
    return np.round(4 * np.log2(total.ravel() + 1)).astype(np.uint8)


def signature(s: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of the set's hashes fall on it. Two sets' signatures
    differ in no more bits than the sets differ in members."""
    cells = (s >> np.uint64(8)) & np.uint64(64 * SIGNATURE - 1)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(k: int, percent: int, levels: np.ndarray):
    names = ["doc_id", "n", "d1", "d2", "prefix", "signature"]
    types = [*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for own, bodies in chunks(ids, texts):
                hashes, bounds = shingles(bodies, k)
                rows = []
                for doc, a, b in zip(own, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    s = np.unique(hashes[a:b])
                    n = len(s)
                    order = np.lexsort((s, levels[s >> np.uint64(64 - SKETCH_BITS)]))
                    prefix = s[order[: n - _least(n, percent) + 1]] if n else s
                    # Sums do not depend on the order: a digest of the set.
                    d1, d2 = mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(BASES[1])).sum(dtype=np.uint64)
                    rows.append((doc, n, d1.astype(np.int64), d2.astype(np.int64), prefix.view(np.int64), signature(s)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names
                )

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        bodies = [pack((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["id", "body"])


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            linked, held = [], {}
            for i, j, x, y in zip(a, b, left, right, strict=True):
                for key, body in ((i, x), (j, y)):
                    if key not in held:
                        if len(held) > 256:
                            held.clear()
                        held[key] = np.unique(shingles([open_(body)], k)[0])
                if i not in held:  # cleared meanwhile
                    held[i] = np.unique(shingles([open_(x)], k)[0])
                s, t = held[i], held[j]
                spot = np.searchsorted(s, t)
                both = int((s[np.minimum(spot, len(s) - 1)] == t).sum()) if len(s) and len(t) else 0
                linked.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    return run


def jaccard_join(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, one row per row of ``docs``.

    Null and blank texts have an empty set and link with nothing. Rows that repeat an id are
    one document with several texts: the component of an id holds whatever any of its rows links
    with. Rows without an id are not compared; their component is null. Other columns are
    ignored. Shingles are told apart by a 64-bit hash.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard-join")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    levels = shingle_levels(rows.select("text"), shingle)
    shape = "doc_id bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, signature array<bigint>"
    facts = rows.mapInArrow(tidy(_describe(shingle, percent, levels)), shape)
    facts = facts.withColumns({"p1": F.xxhash64("prefix"), "p2": F.hash("prefix")})
    facts = work.save(facts, "facts")
    known = facts.filter("n > 0 AND doc_id IS NOT NULL")
    keys = known.drop("prefix")

    # Classes of equal sets and groups of equal prefixes; each is named by its smallest id.
    classes = keys.groupBy("n", "d1", "d2", "p1", "p2").agg(
        F.min("doc_id").alias("rep"), *[F.min(F.col("signature")[i]).alias(f"s{i}") for i in range(SIGNATURE)]
    )
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"))
    groups = work.save(groups, "groups")
    classes = work.save(classes.join(groups, ["n", "p1", "p2"]), "classes")
    lead = known.join(groups, ["n", "p1", "p2"]).filter("doc_id = gid").select("gid", "prefix")
    # Rows that repeat an id with its text give an entry twice; that changes no later step.
    entries = lead.select("gid", F.posexplode("prefix").alias("pos", "shingle"))
    # One shuffle of all entries tells which of them several groups have.
    holders = Window.partitionBy("shingle")
    entries = entries.withColumns({"_a": F.min("gid").over(holders), "_b": F.max("gid").over(holders)})
    posted = work.save(entries.filter("_a < _b").select("gid", "pos", "shingle").distinct(), "posted")
    work.drop("groups")

    # Texts of all classes that may take part in a pair.
    # Groups of several classes share all their lists, also those that no other group has: one more list.
    several = classes.groupBy("gid").agg(F.count("*").alias("m")).filter("m > 1")
    several = several.select("gid", F.lit(1).alias("c"), F.lit(True).alias("several"))
    held = posted.groupBy("gid").agg(F.count("*").alias("c")).withColumn("several", F.lit(False))
    active = held.unionByName(several).groupBy("gid").agg(F.sum("c").alias("lists"), F.max("several").alias("several"))
    active = work.save(active, "active")
    # A copy's own changes are rare shingles that nobody shares; what it was copied from has all
    # of its prefix in common with others. So the class with the largest shared part of its
    # prefix leads a list: most of a family link with their original at once.
    lead = (F.col("lists") / _prefix("n", percent)).alias("lead")
    ranked = work.save(classes.join(active, "gid").select("gid", "rep", "n", lead, "several").distinct(), "ranked")
    bodies = rows.filter("doc_id IS NOT NULL").mapInArrow(tidy(_squeeze), "id bigint, body binary")
    needed = work.save(ranked.select(F.col("rep").alias("id")).distinct(), "needed")
    bodies = bodies.join(needed.hint("merge"), "id", "left_semi")
    # Every round of verification joins these twice: only the pairs are shuffled then.
    bodies = work.save_buckets(bodies, "bodies", "id")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (``a``, ``b``) that link. Each ``a`` finds its text in the buckets. Very many may
        have the same ``b``: those texts are a plain table, so adaptive execution can split a hot one."""
        # Sort-merge at every size: a small set of pairs would be broadcast on small inputs only.
        ends = pairs.select(F.col("b").alias("id")).distinct().hint("merge")
        ends = work.save(bodies.join(ends, "id", "left_semi"), f"{name}-ends")
        left = pairs.hint("merge").join(bodies.select(F.col("id").alias("a"), F.col("body").alias("_left")), "a")
        both = left.hint("merge").join(ends.select(F.col("id").alias("b"), F.col("body").alias("_right")), "b")
        tried = both.select("a", "b", "_left", "_right").mapInArrow(
            tidy(_verify(shingle, percent)), "a bigint, b bigint, linked boolean"
        )
        linked = work.save(tried.filter("linked").select("a", "b").distinct(), name)
        work.drop(f"{name}-ends")
        return linked

    # Groups that share all of their prefix, and the classes of one group, in lists with a flag.
    columns = ["whole", "shingle", "pos", "rep", "n", "lead"]
    shared_by = posted.join(ranked, "gid").withColumn("whole", F.lit(False)).select(*columns)
    alone = ranked.filter("several").select("rep", F.col("gid").alias("shingle"), "n", "lead")
    alone = alone.withColumns({"whole": F.lit(True), "pos": F.lit(0)}).select(*columns)
    listed = work.save(shared_by.unionByName(alone), "listed")
    for name in ("posted", "active", "ranked", "needed"):
        work.drop(name)
    lists = ["whole", "shingle"]
    # Sizes fall into bands twice, the second time shifted by half, so that classes on either
    # side of a boundary meet as well.
    log = F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))
    bands = F.explode(F.array(F.floor(log) * 2, F.floor(log + 0.5) * 2 + 1))

    # Who leads a list's band does not depend on the components, so it is found once for all rounds. A
    # list and its bands lie in one task: the window's rows spill, they are not held at once.
    banded = listed.repartition(*lists).withColumn("band", bands)
    first = F.max(F.struct("lead", (-F.col("rep")).alias("_rep"), "n")).over(Window.partitionBy(*lists, "band"))
    met = banded.withColumn("best", first).select("whole", "band", "rep", "n", (-F.col("best._rep")).alias("hub"), F.col("best.n").alias("m"))
    # A pair meets once a list in either kind of band.
    kinds = [F.count_if(F.pmod("band", F.lit(2)) == kind) for kind in (0, 1)]
    met = met.filter("rep <> hub").groupBy("rep", "hub", "n", "m").agg(F.greatest(*kinds).alias("c"), F.max("whole").alias("same"))
    met = met.filter(F.col("same") | (F.col("c") + _rest("n", "m", percent) >= _need("n", "m", percent)))
    met = work.save(met.select(F.col("rep").alias("a"), F.col("hub").alias("b"), "c"), "met")

    links, joined, tested, turn = None, None, None, 0
    while True:
        turn += 1
        pairs = met
        if joined is not None:
            for end in ("a", "b"):
                of = joined.select(F.col("id").alias(end), F.col("component").alias(f"_of_{end}"))
                pairs = pairs.join(of, end, "left").withColumn(f"_of_{end}", F.coalesce(f"_of_{end}", end))
            pairs = pairs.filter("_of_a <> _of_b").join(tested, ["a", "b"], "left_anti")
        best = pairs.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("_b"))).alias("best"))
        stars = work.save(best.select("a", (-F.col("best._b")).alias("b")), f"stars-{turn}")
        if turn > 1 and stars.isEmpty():
            break
        new = verified(stars, f"links-{turn}")
        both_ways = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tested = both_ways if tested is None else tested.union(both_ways)
        if turn > 1 and new.isEmpty():
            break
        links = new if links is None else links.union(new)
        joined = components(work, links, f"families-{turn}")
    work.drop("met")

    # What a list still holds in different components: pairs, counted as they meet.
    members = listed.join(joined, F.col("rep") == F.col("id"), "left")
    members = members.select(*lists, "pos", "rep", "n", F.coalesce("component", "rep").alias("component"))
    inside = Window.partitionBy(*lists)
    members = members.withColumns({"_a": F.min("component").over(inside), "_b": F.max("component").over(inside)})
    members = work.save(members.filter("_a < _b").drop("_a", "_b"), "members")
    work.drop("listed")
    signs = classes.select("rep", *[f"s{i}" for i in range(SIGNATURE)])
    signed = work.save(members.join(signs.hint("merge"), "rep"), "signed")
    work.drop("members")
    x = signed.select(*lists, F.col("pos").alias("i"), F.col("rep").alias("a"), "n", F.col("component").alias("ca"),
                      *[F.col(f"s{i}").alias(f"x{i}") for i in range(SIGNATURE)])
    y = signed.select(*lists, F.col("pos").alias("j"), F.col("rep").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"),
                      *[F.col(f"s{i}").alias(f"y{i}") for i in range(SIGNATURE)])
    need = _need("n", "m", percent)
    like = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(SIGNATURE)), F.lit(0))
    early = (F.col("n") - F.col("i") >= need) & (F.col("m") - F.col("j") >= need)
    # The first shingle that a linked pair shares lies early in both, so the pair meets there; where it
    # meets later as well, no row is made.
    near = x.join(y, lists).filter("ca < cb").filter(like & early & (F.col("n") + F.col("m") - apart >= 2 * need))
    near = work.save(near.select("a", "n", "b", "m").distinct().join(tested, ["a", "b"], "left_anti"), "near")
    # Only these pairs are counted over the whole of their prefixes.
    ends = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
    ends = work.save(ends, "ends")
    prefixes = known.select(F.col("doc_id").alias("rep"), "n", "prefix").join(ends, "rep", "left_semi")
    prefixes = work.save(prefixes, "prefixes")
    right = prefixes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("prefix").alias("_right"))
    left = prefixes.select(F.col("rep").alias("a"), "n", F.col("prefix").alias("_left"))
    both = near.join(right, ["b", "m"]).join(left, ["a", "n"])
    c = F.size(F.array_intersect("_left", "_right"))
    likely = both.filter(c + _rest("n", "m", percent) >= need)
    second = work.save(likely.select("a", "b").distinct(), "second")
    for name in ("near", "ends", "prefixes"):
        work.drop(name)
    work.drop("signed")
    links = work.save(links.union(verified(second, "second-links")), "links")
    work.drop("bodies")
    joined = components(work, links, "components")

    final = classes.join(joined, F.col("rep") == F.col("id"), "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    final = work.save(final, "final")
    for name in ("classes", "links"):
        work.drop(name)
    return (
        facts.select("doc_id", "n", "d1", "d2")
        .join(final, ["n", "d1", "d2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component stays, the one with the smallest id; all columns unchanged."""
    work = Workspace(docs.sparkSession, "jaccard-keep")
    judged = jaccard_join(docs, doc_id, text, **options)
    gone = judged.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = work.save(gone, "gone")
    rows = boxed(docs, _id=F.col(doc_id))
    # Sort-merge at every size, as the ids may be too many to broadcast.
    return rows.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
