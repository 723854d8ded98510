"""Sharding by balanced label propagation.

Equal texts are linked. Every document starts in a shard; then rounds of joins let linked
documents move to the shard where most of their neighbours are, as far as that shard's quota
allows. Unlinked documents are the ballast: they fill what the groups leave free, so the
row counts of the shards differ by one at most (the law ``rows``).

The state is one row per group and shard with a count, since the documents of a group in one
shard are alike. A group larger than a shard (one text may be a third of all rows) is split at
row level. Quotas are filled along a total order with running sums over range partitions, so no
shard and no group is ever one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace, running

LAW = "rows"
ROUNDS = 6


def _facts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    )


def _quotas(total: int, shards: int) -> dict[int, int]:
    """Rows that each shard holds in the end: the first shards take one more."""
    return {k: total // shards + (k < total % shards) for k in range(shards)}


def _per_shard(rows: DataFrame, *keys: str) -> dict:
    """Sums of ``n`` by shard, or by pair of shards: as many rows as the caller asked shards."""
    keys = keys or ("shard",)
    found = rows.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n")).collect()
    return {(r[0] if len(keys) == 1 else tuple(r[:-1])): r[-1] for r in found}


def _lookup(values: dict, *keys: str) -> Column:
    """The value of a small dictionary for these columns, 0 where it has none."""
    name = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    at = {",".join(map(str, k if isinstance(k, tuple) else (k,))): v for k, v in values.items()}
    if not at:
        return F.lit(0).cast("bigint")
    table = F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return F.coalesce(F.try_element_at(table, name), F.lit(0).cast("bigint"))


def _choose(cells: DataFrame) -> DataFrame:
    """Each group with the shard that holds most of it; ties take the smaller number."""
    best = F.max(F.struct(F.col("n"), (-F.col("shard")).alias("_minus")))
    return cells.groupBy("digest").agg(best.alias("_best"), F.sum("n").alias("members")).select(
        "digest", "members", (-F.col("_best._minus")).cast("int").alias("target")
    )


def _round(work: Workspace, cells: DataFrame, quotas: dict, turn: int) -> DataFrame:
    """Move group members towards their target shard.

    Between two shards equal numbers may always change places; on top of that a shard takes as
    many as it has room for, shared among the senders by demand. Small groups come first: they
    fit whole.
    """
    wish = work.save(cells.join(_choose(cells), "digest"), f"wish{turn}")
    movers = wish.filter("shard <> target")
    held, asked = _per_shard(wish), _per_shard(movers, "shard", "target")
    into = {t: sum(n for (_, to), n in asked.items() if to == t) for t in quotas}
    allowed = {}
    for (s, t), n in asked.items():
        swap = min(n, asked.get((t, s), 0))
        room = max(0, quotas[t] - held.get(t, 0))
        allowed[s, t] = min(n, swap + room * n // into[t])
    if not any(allowed.values()):
        return cells
    ranked = running(
        work, f"asked{turn}", movers, ["shard", "target"], ["members", "digest"], "n", "_before"
    )
    room = _lookup(allowed, "shard", "target") - F.col("_before")
    moved = ranked.withColumn("_go", F.greatest(F.lit(0), F.least("n", room)).cast("bigint"))
    moved = work.save(moved, f"moved{turn}")
    parts = (
        wish.filter("shard = target")
        .select("digest", "shard", "n")
        .unionByName(moved.select("digest", F.col("target").alias("shard"), F.col("_go").alias("n")))
        .unionByName(moved.select("digest", "shard", (F.col("n") - F.col("_go")).alias("n")))
    )
    settled = parts.filter("n > 0").groupBy("digest", "shard").agg(F.sum("n").alias("n"))
    return work.save(settled, f"cells{turn}")


def _fit(work: Workspace, cells: DataFrame, quotas: dict) -> DataFrame:
    """Take what exceeds a quota out of its shard and put it where there is room."""
    placed = running(work, "fit", cells, ["shard"], ["n", "digest"], "n", "_before")
    room = _lookup(quotas, "shard") - F.col("_before")
    stays = F.greatest(F.lit(0), F.least("n", room)).cast("bigint")
    placed = work.save(placed.withColumn("_stays", stays), "fitted")
    used = _per_shard(placed.select("shard", F.col("_stays").alias("n")))
    over = placed.filter("n > _stays").select(
        "digest", "shard", (F.col("n") - F.col("_stays")).alias("n"), F.lit(0).alias("all")
    )
    over = running(work, "over", over, ["all"], ["digest", "shard"], "n")
    dealt = _deal(over, {k: q - used.get(k, 0) for k, q in quotas.items()})
    return (
        placed.select("digest", "shard", F.col("_stays").alias("n"))
        .unionByName(dealt.select("digest", "shard", "n"))
        .filter("n > 0")
        .groupBy("digest", "shard")
        .agg(F.sum("n").alias("n"))
    )


def _deal(rows: DataFrame, rooms: dict) -> DataFrame:
    """Lay rows that stand at ``before`` and count ``n`` over the rooms of the shards, in turn."""
    start, spans = 0, []
    for shard, room in sorted(rooms.items()):
        spans.append((start, start + room, shard))
        start += room
    table = F.array(
        *[
            F.struct(
                F.lit(a).cast("bigint").alias("a"),
                F.lit(b).cast("bigint").alias("b"),
                F.lit(k).cast("int").alias("k"),
            )
            for a, b, k in spans
        ]
    )
    end = F.col("before") + F.col("n")
    hits = F.filter(table, lambda s: (s["a"] < end) & (s["b"] > F.col("before")))
    laid = rows.withColumn("_hit", F.explode(hits))
    overlap = F.least(end, F.col("_hit.b")) - F.greatest("before", F.col("_hit.a"))
    return laid.withColumns({"n": overlap.cast("bigint"), "shard": F.col("_hit.k")})


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Sizes count UTF-8 bytes plus one; a null text counts as empty and is linked with empty
    texts. Slots number a shard's documents from 0 by id. Rows may repeat an id: each is a
    row of its own, and rows that are alike in all these columns are interchangeable. Other
    columns of the input are ignored; an empty table gives an empty result. ``grown_shard`` is
    null, since the law ``rows`` deals rows anew for another shard count.
    """
    work = Workspace(docs.sparkSession, "sharding")
    facts = work.save(_facts(docs, doc_id, text), "facts")
    sizes = facts.groupBy("digest").agg(F.count("*").alias("members"))
    groups = work.save(sizes.filter("members > 1"), "groups")
    linked = facts.join(groups, "digest")
    single = facts.join(groups, "digest", "left_anti")
    quotas = _quotas(facts.count(), shards)

    # The start: ids dealt by hash, as counts per group and shard.
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    cells = linked.withColumn("shard", start).groupBy("digest", "shard")
    cells = _fit(work, work.save(cells.agg(F.count("*").alias("n")), "start"), quotas)
    cells = work.save(cells, "cells")
    for turn in range(rounds):
        moved = _round(work, cells, quotas, turn)
        if moved is cells:  # nobody may move any more
            break
        cells = moved

    # Documents take the places of their group in order of id.
    order = Window.partitionBy("digest").orderBy("shard")
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = work.save(cells.withColumn("_end", F.sum("n").over(order)), "ends")
    whole = ends.join(groups, "digest").filter("n = members").select("digest", "shard")
    split = ends.join(groups, "digest").filter("n < members")
    split = split.select("digest", "shard", "_end", (F.col("_end") - F.col("n")).alias("_start"))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    together = linked.join(whole, "digest").select(*columns)
    ranked = running(
        work,
        "ranked",
        linked.join(split.select("digest").distinct(), "digest"),
        ["digest"],
        ["doc_id", "size"],
        into="_rank",
    )
    inside = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    spans = split.groupBy("digest").agg(
        F.collect_list(F.struct("_start", "_end", "shard")).alias("_spans")  # one per shard
    )
    apart = (
        work.save(ranked, "apart")
        .join(work.save(spans, "spans"), "digest")
        .select("*", F.inline("_spans"))
        .filter(inside)
        .select(*columns)
    )

    # Unlinked documents fill what is free, and stay where they started if they can.
    used = _per_shard(cells)
    free = {k: q - used.get(k, 0) for k, q in quotas.items()}
    alone = running(
        work, "alone", single.withColumn("shard", start), ["shard"], ["doc_id", "digest"], into="_rank"
    )
    alone = work.save(alone.withColumn("_home", F.col("_rank") < _lookup(free, "shard")), "homes")
    at_home = alone.filter("_home")
    kept = _per_shard(at_home.withColumn("n", F.lit(1)))
    moving = alone.filter("NOT _home").withColumn("all", F.lit(0)).drop("_rank", "_home", "shard")
    moving = running(work, "moving", moving, ["all"], ["doc_id", "digest"])
    moved = _deal(moving.withColumn("n", F.lit(1)), {k: n - kept.get(k, 0) for k, n in free.items()})
    moved = moved.select(*columns)

    settled = together.unionByName(apart).unionByName(at_home.select(*columns)).unionByName(moved)
    slotted = running(work, "slotted", settled, ["shard"], ["doc_id", "text_crc32", "size"], into="slot")
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
