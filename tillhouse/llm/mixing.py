"""Mixing sources to target weights with Sainte-Laguë apportionment.

The words of a source, its documents laid end to end in a seeded order, are cut into blocks of
equal length. The blocks of the mix are seats: seat k of a source has the quotient
target / (2k + 1), and the highest quotients get the seats. The order of the quotients also deals the
seats to output shards, so each shard has an integer quota of every source. A source with
more seats than blocks repeats its blocks; the blocks that are taken once more than the others
are chosen by the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace, boxed, running

WORD = r"[^\x20\x09-\x0D]+"
# Blocks that the whole corpus is cut into, and the least number for any one source.
BLOCKS = 1 << 16
LEAST_BLOCKS = 32
MOST_REPEATS = 3
# Parts that a fraction of a copy is counted in: sums of billions of them fit a bigint.
FRACTION = 1 << 28


def n_words(text: str | Column = "text") -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("bigint")


def capped_targets(
    work: Workspace, sources: DataFrame, weights: Sequence[int], most: int
) -> DataFrame:
    """Targets by weight that add up to all sizes, none above ``most`` times its source.

    What a full source cannot take is shared by weight among the others until none is above.
    That is a common level: the target is the smaller of ``most * size`` and ``level * weight``.
    In order of size per weight, the full sources come first; each row checks whether the level
    that its predecessors leave would fill it.
    """
    ranked = running(work, "by-name", sources, ["all"], ["source"], into="rank")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    ranked = ranked.withColumn("weight", weight).withColumn("_ratio", F.col("source_size") / F.col("weight"))
    ranked = work.save(ranked, "weighted")
    order = ["_ratio", "rank"]
    by_size = running(work, "by-ratio", ranked, ["all"], order, "source_size", "_full_size")
    by_both = running(work, "by-ratio-weight", by_size, ["all"], order, "weight", "_full_weight")
    by_both = work.save(by_both, "levels")
    sums = by_both.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(sums.size) - most * F.col("_full_size")) / (
        F.lit(sums.weight) - F.col("_full_weight")
    )
    tried = by_both.withColumn("_level", level)
    # The first source in this order that is not full sets the level for it and all later ones.
    fits = tried.filter(F.col("_level") * F.col("weight") <= most * F.col("source_size"))
    found = fits.agg(F.min(F.struct("_ratio", "rank", "_level")).alias("first")).first().first
    shared = (found._level if found else 0.0) * F.col("weight")
    return by_both.select(
        "source",
        "rank",
        "source_size",
        F.least((most * F.col("source_size")).cast("double"), shared.cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: int = MOST_REPEATS,
    shards: int = 8,
    seed: int = 17,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``taken``, ``shards`` (those that its blocks went to).

    Sizes are words; a null text has none. A null source is a source of its own, ordered last. A
    source without words has target 0. No block is taken more than ``most`` times. Documents are
    ordered by seed, id and size, so reruns agree. Rows that repeat an id are documents of their
    own; those alike in source, id and size may swap their answers.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    facts = work.save(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size")
        ),
        "facts",
    )
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Nulls last: the flag leads the order.
    named = sizes.select(
        F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name")).alias("source"),
        "source_size",
        F.lit(0).alias("all"),
    )
    targets = capped_targets(work, named, weights, most)
    words = facts.agg(F.sum("size").alias("n")).first().n or 0
    share = F.ceil(F.col("source_size") * blocks / max(words, 1))
    n_blocks = F.least("source_size", F.greatest(share, F.lit(LEAST_BLOCKS))).cast("bigint")
    plan = work.save(
        targets.withColumn("n_blocks", n_blocks).withColumn(
            # In units of the source's own blocks.
            "_want", F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))
        ),
        "plan",
    )

    # Seats by highest quotient. A source can win no seat beyond its repeats.
    seats = plan.filter("n_blocks > 0").select(
        "source",
        "rank",
        "n_blocks",
        "_want",
        F.explode(
            F.sequence(
                F.lit(0).cast("bigint"),
                F.least(F.col("n_blocks") * most, F.ceil("_want") * 2 + 2) - 1,
            )
        ).alias("seat"),
    )
    quotient = -(F.col("_want") / (2 * F.col("seat") + 1))
    seats = seats.withColumn("all", F.lit(0)).withColumn("_quotient", quotient)
    won = running(work, "quotients", seats, ["all"], ["_quotient", "rank", "seat"], into="place")
    count = round(plan.agg(F.sum("_want").alias("n")).first().n or 0)
    won = work.save(
        won.filter(F.col("place") < count).select(
            "rank",
            (F.col("place") % shards).cast("int").alias("shard"),
            (F.col("seat") % F.col("n_blocks")).alias("nth"),
        ),
        "seats",
    )

    # The seeded order of the blocks of a source: seat k takes block k, from the start again
    # once all are taken.
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1))
    cut = plan.filter("n_blocks > 0").select("rank", block.alias("block"))
    drawn = running(
        work,
        "blocks",
        cut,
        ["rank"],
        [F.xxhash64(F.lit(seed), F.col("rank"), F.col("block")), "block"],
        into="nth",
    )
    per_block = won.groupBy("rank", "nth").agg(
        F.count("*").alias("times"), F.collect_set("shard").alias("shards")
    )
    times = work.save(drawn.join(per_block, ["rank", "nth"]).drop("nth"), "times")

    # Where each document lies in its source.
    on_source = F.col("f.source").eqNullSafe(F.col("p.source.name"))
    known = facts.alias("f").join(plan.alias("p"), on_source).select("f.*", *[
        f"p.{c}" for c in ("rank", "source_size", "target", "n_blocks")
    ])
    laid = running(
        work,
        "laid",
        known,
        ["rank"],
        [F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id", "size"],
        "size",
        "start",
    )
    laid = work.save(laid.withColumn("row", F.monotonically_increasing_id()), "placed")
    # Block b holds the words from floor(b * size / n) on.
    first = F.floor(F.col("start") * F.col("n_blocks") / F.col("source_size"))
    last = F.floor((F.col("start") + F.col("size") - 1) * F.col("n_blocks") / F.col("source_size"))
    touched = laid.filter("size > 0").select(
        "row", "rank", "start", "size", "source_size", "n_blocks",
        F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.col("n_blocks") - 1))).alias("block"),
    )
    edge = lambda b: F.expr(f"({b}) * source_size div n_blocks")
    overlap = F.least(F.col("start") + F.col("size"), edge("block + 1")) - F.greatest(
        F.col("start"), edge("block")
    )
    taken = (
        touched.join(times, ["rank", "block"])
        .withColumn("_words", overlap)
        .filter("_words > 0")
        .groupBy("row")
        .agg(
            F.sum(F.col("_words") * F.col("times")).alias("taken"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("shards"),
        )
    )
    return laid.join(taken, "row", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
    )


def repeat_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    **options,
) -> DataFrame:
    """The mix as whole documents, all columns unchanged.

    A document comes as often as the whole part of what its words are taken on average, and once
    more when the fractions, added up along its source in order of length (equal lengths by
    seed), pass a half and each whole number after it. So the words that come differ from those
    taken by at most the longest document of the source, however long the blocks are. A document
    without words is neither taken nor refused: it stays once. Rows that repeat source, id and
    size share one average and come alike; together they count as one document.
    """
    work = Workspace(docs.sparkSession, "mix-documents")
    taken = mix(docs, doc_id, text, source, seed=seed, **options).groupBy(
        F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name")).alias("_source"),
        F.col("doc_id").alias("_id"),
        F.col("size").alias("_size"),
    )
    per_id = taken.agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_words")).filter("_words > 0")
    average = F.col("_taken") / F.col("_words")
    per_id = per_id.withColumns({
        "_whole": F.floor(average),
        "_fraction": F.round((average - F.floor(average)) * FRACTION).cast("bigint"),
    })
    order = ["_words", F.xxhash64(F.lit(seed), F.col("_id")), "_id"]
    carried = running(work, "fractions", per_id, ["_source"], order, "_fraction", "_before")
    turn = lambda c: F.floor((c + F.lit(FRACTION // 2)) / F.lit(FRACTION))
    extra = turn(F.col("_before") + F.col("_fraction")) - turn(F.col("_before"))
    copies = (F.col("_whole") + extra).cast("int").alias("_copies")
    counts = work.save(carried.select("_source.name", "_id", "_size", copies), "copies")
    # Left: a document without words has no count. Sort-merge at every size, as the counts may be
    # too many to broadcast.
    rows = boxed(docs, _own=F.col(doc_id), _from=F.col(source), _n=n_words(text))
    same = (
        F.col("_own").eqNullSafe(F.col("_id"))
        & F.col("_from").eqNullSafe(F.col("_name"))
        & (F.col("_n") == F.col("_size"))
    )
    joined = rows.join(counts.withColumnRenamed("name", "_name").hint("merge"), same, "left")
    times = F.explode(F.array_repeat(F.lit(0), F.coalesce("_copies", F.lit(1))))
    return joined.withColumn("_time", times).select("_row.*")
