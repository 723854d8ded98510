"""URL filter: rules by host and path, and trust spread over the link graph.

Hosts that the rules allow are trusted seeds, hosts that they block are distrusted ones. A host is a
seed by the share of its pages that a rule of that verdict fits; one without pages, only linked
to, by the rule that fits all of it. So a rule makes a full seed only of a host that it covers wholly.

Trust follows links (personalised PageRank): a seed starts with its share and passes on ``damping`` of
what it gets, by the share of its links. It is counted in seeds: 1 is what a full seed starts with.
Distrust follows links backwards: a host has its own share of blocked pages and, for the rest of
it, ``damping`` times the distrust of the hosts that it links to, by the share of its links. So it
lies between 0 and 1: a host whose links all go to blocked hosts has 0.85, one with a single such
link in a hundred 0.0085. A url that no rule fits is blocked when its host's distrust exceeds its
trust by ``THRESHOLD``: about half of what a host can get by linking to blocked hosts only.

Both spread in increments, one join and one aggregate a turn over what the last turn added, until no
host gains more than ``TOLERANCE``; increments shrink by ``damping`` a turn, so this always ends, and paths
of any length count. Edges and scores are Spark tables; links are counted before anything is
shuffled, and what a hub passes on is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.workspace import Workspace

# Rule and verdict; a rule is a host and the start of a path.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
DAMPING = 0.85
TOLERANCE = 1e-4
THRESHOLD = 0.4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links between hosts, ``src`` and ``dst`` with their number. ``pages`` has ``host``.

    Relative links stay on their host and say nothing; so do links to the own host.
    """
    links = F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)))
    linked = pages.filter(F.col(html).contains("//")).select(F.col("host").alias("src"), links.alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return (
        linked.select("src", host(target).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each (``host``, ``path``), and its verdict.

    ``rules`` has ``rule_host``, ``rule_path``, ``rule``, ``rule_verdict``. A page looks up every
    suffix of its host, so the number of rules does not matter.
    """
    keys = ["host", "path"]
    places = pages.select(*keys).distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
    )
    fits = (
        places.select(*keys, suffix.alias("rule_host"))
        .join(rules, "rule_host")
        .filter(F.col("path").startswith(F.col("rule_path")))
    )
    longest = F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best")
    return fits.groupBy(*keys).agg(longest).select(*keys, "best.rule", "best.rule_verdict")


def spread(
    work: Workspace,
    name: str,
    edges: DataFrame,
    seeds: DataFrame,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``host`` and ``score``: what seeds (``host``, ``weight``) start with and all that reaches a host.

    ``edges`` has ``src``, ``dst``, ``share``: the part of ``src``'s gain that ``dst`` gains, damped. Every
    turn is written down, so losing an executor never repeats earlier ones.
    """
    gain = work.save(seeds.select("host", F.col("weight").alias("score")), f"{name}-0")
    total, turn = gain, 0
    while not edges.isEmpty() and not gain.filter(F.col("score") > tolerance).isEmpty():
        turn += 1
        passed = edges.join(gain, edges.src == gain.host).select(
            F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score")
        )
        gain = work.save(passed.groupBy("host").agg(F.sum("score").alias("score")), f"{name}-{turn}")
        added = total.unionByName(gain).groupBy("host").agg(F.sum("score").alias("score"))
        total = work.save(added, f"{name}-total-{turn}")
        work.drop(f"{name}-total-{turn - 1}")
        work.drop(f"{name}-{turn - 2}")
    return total


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``; a row per page.

    A null url, or one without ``://``, has an empty host and path: no rule fits it and it is
    no part of the graph, so it is allowed. A null page has no links. A host that both kinds of
    rule name is a seed of both, by the shares of its pages. Repeated rows are judged alike.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "url-filter")
    split = [(r[: r.index("/")], r[r.index("/") :], r, v) for r, v in rules]
    table = spark.createDataFrame(
        split, "rule_host string, rule_path string, rule string, rule_verdict string"
    )
    placed = pages.select(
        F.col(page_id).alias("page_id"), host(url).alias("host"), path(url).alias("path"), F.col(html).alias("html")
    )
    linked = work.save(host_edges(placed, "html"), "links")
    bare = work.save(placed.drop("html"), "pages")
    rule = work.save(match_rules(bare, table), "rules")

    # Each host's share of allowed and of blocked pages. Hosts that are only linked to count as one
    # page at their root.
    on_pages = bare.filter("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    on_pages = work.save(on_pages, "places")
    linked_to = linked.select(F.col("dst").alias("host")).distinct()
    alone = linked_to.join(on_pages.select("host"), "host", "left_anti").select("host", F.lit("/").alias("path"))
    alone_rule = match_rules(alone, table)
    seen = on_pages.join(rule, ["host", "path"], "left").select("host", "n", "rule_verdict")
    seen = seen.unionByName(
        alone_rule.select("host", F.lit(1).cast("bigint").alias("n"), "rule_verdict")
    )
    part = lambda v: (F.sum(F.when(F.col("rule_verdict") == v, F.col("n")).otherwise(0)) / F.sum("n")).alias(v)
    seeds = work.save(seen.groupBy("host").agg(part("allow"), part("block")), "seeds")

    out = work.save(linked.groupBy("src").agg(F.sum("links").alias("all")), "out")
    ways = linked.join(out, "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share"))
    ways = work.save(ways, "ways")
    # Backwards, a link gives its source a share of its target's distrust, for the part of the source
    # that is not blocked itself.
    open_part = F.col("share") * (1 - F.coalesce("block", F.lit(0.0)))
    back = ways.join(seeds.select(F.col("host").alias("src"), "block"), "src", "left").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), open_part.alias("share")
    )
    back = work.save(back, "back")

    def seeded(verdict: str) -> DataFrame:
        return seeds.filter(F.col(verdict) > 0).select("host", F.col(verdict).alias("weight"))

    trust = spread(work, "trust", ways, seeded("allow"), damping, tolerance)
    distrust = spread(work, "distrust", back, seeded("block"), damping, tolerance)
    scores = work.save(
        trust.withColumnRenamed("score", "trust")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
        .na.fill(0.0, ["trust", "distrust"]),
        "scores",
    )
    judged = bare.join(rule, ["host", "path"], "left").join(scores, "host", "left")
    known = judged.na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return known.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", method).alias("verdict"),
        "trust",
        "distrust",
    )
