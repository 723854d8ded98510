"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a sequence of units: words, and single characters of scripts that write no blanks. Each run
of ``k`` units has a rolling (Karp-Rabin) hash: the polynomial of the units' CRC-32 in ``BASE`` modulo
``PRIME``. Of every ``w`` consecutive hashes the least is picked, of equal ones the rightmost, with its
position. So two texts that share ``w + k - 1`` units in a row share a picked hash, and no run shorter
than ``k`` units can make them share one. With fewer than ``k`` units all of them make one run, with
fewer than ``w`` hashes all of them make one window; without units nothing is picked.

A pick is one bigint: the hash above ``POSITION_BITS`` bits that count positions down, so the least
of a window is the least hash and, of equal ones, the rightmost. Positions repeat from 0 after
2^24 units. Arrays of one text live in one task: a few hundred bytes for each unit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace, running

UNSPACED = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
UNITS, WINDOW = 5, 6
# The greatest prime below 2^38, and a base that keeps every product below 2^63.
PRIME = (1 << 38) - 45
BASE = 9_999_991
POSITION_BITS = 24
POSITIONS = 1 << POSITION_BITS
# Documents that are neighbours in the order share a block with the first one after them.
BLOCK = 64


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in the body use it."""
    return F.transform(F.array(value), body)[0]


def _roll(value: Column, unit: Column) -> Column:
    return (value * F.lit(BASE) + unit) % F.lit(PRIME)


def picks(text: Column, k: int = UNITS, w: int = WINDOW) -> Column:
    """The picks of a text (array of bigint) in the order of their positions."""
    one = F.lit(1).cast("bigint")

    def at(array: Column, i: Column, j: int) -> Column:
        return F.get(array, i + j)

    def packed(value: Column, i: Column) -> Column:
        return value * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - i % F.lit(POSITIONS))

    def hashed(units: Column) -> Column:
        whole = F.array(packed(F.aggregate(units, one, _roll), F.lit(0)))
        runs = F.transform(
            F.slice(units, 1, F.greatest(F.size(units) - (k - 1), F.lit(0))),
            lambda first, i: packed(reduce(_roll, [at(units, i, j) for j in range(1, k)], _roll(one, first)), i),
        )
        none = F.array().cast("array<bigint>")
        return F.when(F.size(units) == 0, none).when(F.size(units) < k, whole).otherwise(runs)

    def least(hashes: Column) -> Column:
        # Beyond the end there is null, which least() leaves out.
        return F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - (w - 1), F.lit(1))),
            lambda first, i: F.least(first, *[at(hashes, i, j) for j in range(1, w)]),
        )

    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.crc32(u))
    return F.array_distinct(_bind(_bind(units, hashed), least))


def pick_hash(pick: Column) -> Column:
    return F.shiftright(pick, POSITION_BITS)


def pick_position(pick: Column) -> Column:
    return F.lit(POSITIONS - 1) - pick.bitwiseAND(F.lit(POSITIONS - 1))


def pick_hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, pick_hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of picked hashes; two empty ones are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def written(found: Column) -> Column:
    """Picks as text: ``hash@position`` in ascending position, one blank between."""
    return F.concat_ws(
        " ", F.transform(found, lambda p: F.concat(pick_hash(p).cast("string"), F.lit("@"), pick_position(p).cast("string")))
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = UNITS, w: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` (array of hash and position), one row per row.

    A null text counts as empty: no picks. Other columns are ignored, ids may be null or repeat.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.length(body).cast("bigint").alias("n_chars"),
        F.transform(
            picks(body, k, w), lambda p: F.struct(pick_hash(p).alias("hash"), pick_position(p).alias("position"))
        ).alias("fingerprint"),
    )


def compare_with_edits(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = UNITS, w: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """How fingerprints follow an edit: each document against itself with its last quarter taken from
    the next document, and against that next document.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (see
    ``written``), ``near_edited``, ``near_next``; one row per row of ``docs``. Documents are ordered by
    id, null ids first, rows of one id by a hash of their texts; after the last comes the first, so a
    single document is its own next one. Rows that repeat an id with its text are one document with
    one answer. A null text counts as empty. Other columns are ignored; an empty table gives none.

    Only ids and text hashes are ranked. Texts move twice: to one row per document, then into blocks of
    consecutive documents, where windows look ahead by one row.
    """
    work = Workspace(docs.sparkSession, "fingerprints")
    key = ["_id", "_none", "_hash"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(doc_id), F.lit(0)).cast("bigint").alias("_id"),
        F.col(doc_id).isNull().alias("_none"),
        F.xxhash64(body).alias("_hash"),
        body.alias("text"),
    )
    known = rows.groupBy(*key).agg(F.count("*").alias("copies")).withColumn("all", F.lit(0))
    order = [(~F.col("_none")).alias("_named"), "_id", "_hash"]
    places = work.save(running(work, "ranked", known, ["all"], order, into="place").drop("all"), "places")
    total = places.count()
    # Neighbours: the first document of a block is the next one of the last of the block before.
    place = F.col("place")
    spot = lambda b, p, own: F.struct(
        b.cast("bigint").alias("block"), p.cast("bigint").alias("place"), F.lit(own).alias("own")
    )
    none = F.array().cast("array<struct<block:bigint,place:bigint,own:boolean>>")
    own_block = F.floor(place / block)
    spots = F.concat(
        F.array(spot(own_block, place, True)),
        F.when((place > 0) & (place % block == 0), F.array(spot(own_block - 1, place, False))).otherwise(none),
        F.when(place == 0, F.array(spot(F.lit((total - 1) // block), F.lit(total), False))).otherwise(none),
    )
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    laid = (
        texts.join(places.hint("merge"), key)
        .select("_id", "_none", "copies", "text", F.explode(spots).alias("spot"))
        .select("_id", "_none", "copies", "text", "spot.*")
    )
    ahead = Window.partitionBy("block").orderBy("place")
    n = F.length("text")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")),
        F.substring(F.col("next"), F.lit(1), F.floor(n / 4).cast("int")),
    )
    paired = laid.withColumn("next", F.lead("text").over(ahead)).withColumn("edited", F.when(F.col("own"), edited))
    found = paired.select(
        "_id", "_none", "copies", "block", "place", "own",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        picks(F.col("text"), k, w).alias("picks"),
        picks(F.col("edited"), k, w).alias("edited_picks"),
    )
    hashed = found.withColumns({"hashes": pick_hashes(F.col("picks")), "edited_hashes": pick_hashes(F.col("edited_picks"))})
    beside = hashed.withColumn("next_hashes", F.lead("hashes").over(ahead)).filter("own")
    return beside.select(
        F.when(~F.col("_none"), F.col("_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        written(F.col("picks")).alias("fingerprint"),
        written(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
