"""DuckDB SQL for the queries that SQL can express. The others are held against brute-force versions
in ``tests/llm``: tokens, sharding, mixing, quality and the link graph."""

from __future__ import annotations

from tillhouse.llm import fingerprints, heap_kmeans, manifest, url_filter
from tillhouse.llm.license_scan import LOWER, PERCENT, TEMPLATES, UPPER

BLANK = r"[\x20\x09-\x0D]+"

COMPONENTS = """
reach AS (
    SELECT id, id AS component FROM nodes
    UNION
    SELECT l.b, r.component FROM reach r JOIN both_ways l ON l.a = r.id
    WHERE l.b > r.component
),
components AS (SELECT id, min(component) AS component FROM reach GROUP BY id)
"""

JACCARD = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BLANK}'), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM texts
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY 1, 2
),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n + m - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT doc_id AS id FROM sets),
{COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component AS component_id
FROM sets JOIN components ON id = doc_id
"""

EXACT = rf"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g')) AS text_sha256
    FROM documents
)
WINDOW same AS (PARTITION BY text_sha256)
"""

SUBSTRINGS = rf"""
WITH texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS w
    FROM documents
),
starts AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM texts
),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM starts),
repeats AS (
    SELECT doc_id, i FROM windows
    QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeats),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

VECTORS = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT vec_id AS id FROM embeddings),
{COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM both_ways WHERE a = id) AS n_links,
       component AS component_id, id = component AS kept
FROM components
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NOTICES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in TEMPLATES)
LICENSES = rf"""
WITH units AS (
    SELECT doc_id, unnest(list_distinct(list_append(string_split(text, chr(10)), text))) AS unit
    FROM documents WHERE text IS NOT NULL
),
worded AS (
    SELECT doc_id, unit, list_filter(regexp_split_to_array(
        translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') AS w
    FROM units
),
short AS (SELECT * FROM worded WHERE len(w) BETWEEN 2 AND 200),
notices AS (
    SELECT license, row_number() OVER () AS t, list_filter(regexp_split_to_array(
        translate(body, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') AS w
    FROM (VALUES {NOTICES}) v(license, body)
),
unit_bigrams AS (
    SELECT doc_id, unit, len(w) - 1 AS n, b, count(*) AS c
    FROM (SELECT doc_id, unit, w, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM short)
    GROUP BY ALL
),
notice_bigrams AS (
    SELECT license, t, len(w) - 1 AS m, b, count(*) AS c
    FROM (SELECT license, t, w, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM notices)
    GROUP BY ALL
),
scored AS (
    SELECT doc_id, unit, license, t, n + m AS total, sum(least(u.c, l.c)) AS k
    FROM unit_bigrams u JOIN notice_bigrams l USING (b) GROUP BY ALL
)
SELECT doc_id, license, max(2.0::DOUBLE * k / total) AS dice, count(DISTINCT unit) AS n_units
FROM scored WHERE 200 * k >= {PERCENT} * total GROUP BY doc_id, license
"""


def _crc32(codes: str) -> str:
    """CRC-32 of a list of bytes, bit by bit: a byte goes in, then eight shifts."""
    bits = f"flatten(list_transform({codes}, lambda c: [c::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, b: {turn}), 4294967295)"


_K, _W = fingerprints.UNITS, fingerprints.WINDOW
_BYTES = "list_transform(range(0, strlen(unit)), lambda i: ('0x' || substr(hex(unit), 2 * i + 1, 2))::BIGINT)"
# Polynomial of the last k units up to each row; fewer units make one run of all.
_ROLL = "1::BIGINT"
for _j in range(_K):
    _ROLL = f"(({_ROLL}) * {fingerprints.BASE} + lead(crc, {_j}) OVER along) % {fingerprints.PRIME}"
FINGERPRINTS = rf"""
WITH placed AS (
    SELECT doc_id, coalesce(text, '') AS body, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS later,
           first(coalesce(text, '')) OVER (ORDER BY doc_id) AS earliest, lead(doc_id) OVER (ORDER BY doc_id) AS later_id,
           first(doc_id) OVER (ORDER BY doc_id) AS first_id
    FROM documents
),
pairs AS (
    SELECT doc_id, body, coalesce(later, earliest) AS next, coalesce(later_id, first_id) AS next_id,
           length(body) AS n, length(body) // 4 AS q
    FROM placed
),
edits AS (SELECT *, substr(body, 1, n - q) || substr(next, 1, q) AS edited FROM pairs),
versions AS (SELECT doc_id, 0 AS v, body AS t FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
split AS (SELECT doc_id, v, regexp_extract_all(t, '{fingerprints.UNIT}') AS u FROM versions),
units AS (SELECT doc_id, v, unnest(u) AS unit, unnest(range(0, len(u))) AS i, len(u) AS m FROM split),
codes AS (SELECT unit, {_crc32(_BYTES)} AS crc FROM (SELECT DISTINCT unit FROM units)),
coded AS (SELECT doc_id, v, i, m, crc FROM units JOIN codes USING (unit)),
runs AS (
    SELECT doc_id, v, i, m, {_ROLL} AS h FROM coded WHERE m >= {_K}
    WINDOW along AS (PARTITION BY doc_id, v ORDER BY i)
    UNION ALL
    SELECT doc_id, v, 0, m, list_reduce(list_concat([1::BIGINT], list(crc ORDER BY i)),
                                        lambda a, b: (a * {fingerprints.BASE} + b) % {fingerprints.PRIME})
    FROM coded WHERE m < {_K} GROUP BY doc_id, v, m
),
hashes AS (
    SELECT doc_id, v, i, greatest(m - {_K - 1}, 1) AS g,
           h * {fingerprints.POSITIONS} + ({fingerprints.POSITIONS - 1} - i) AS packed
    FROM runs WHERE h IS NOT NULL
),
windows AS (
    SELECT doc_id, v, i, g, min(packed) OVER (PARTITION BY doc_id, v ORDER BY i
                                              ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING) AS pick
    FROM hashes
),
picked AS (
    SELECT DISTINCT doc_id, v, pick // {fingerprints.POSITIONS} AS h, {fingerprints.POSITIONS - 1} - pick % {fingerprints.POSITIONS} AS spot
    FROM windows WHERE i <= greatest(g - {_W}, 0)
),
prints AS (
    SELECT doc_id, v, string_agg(h || '@' || spot, ' ' ORDER BY spot) AS print, list_distinct(list(h)) AS hs
    FROM picked GROUP BY doc_id, v
),
joined AS (
    SELECT e.doc_id, e.n, sha256(e.edited) AS edited_sha256, coalesce(a.print, '') AS fingerprint,
           coalesce(b.print, '') AS edited_fingerprint, coalesce(a.hs, []) AS own, coalesce(b.hs, []) AS changed,
           coalesce(c.hs, []) AS beside
    FROM edits e
    LEFT JOIN prints a ON a.doc_id = e.doc_id AND a.v = 0
    LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.v = 1
    LEFT JOIN prints c ON c.doc_id = e.next_id AND c.v = 0
)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(own) + len(changed) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(own, changed))::DOUBLE / len(list_distinct(list_concat(own, changed))) END AS near_edited,
       CASE WHEN len(own) + len(beside) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(own, beside))::DOUBLE / len(list_distinct(list_concat(own, beside))) END AS near_next
FROM joined
"""


def _kmeans() -> str:
    steps = [
        f"""kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({heap_kmeans.SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {heap_kmeans.DIMENSIONS}
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {heap_kmeans.DIMENSIONS}
)""",
        f"""c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM kept
    QUALIFY c < {heap_kmeans.CLUSTERS}
)""",
    ]
    for turn in range(heap_kmeans.ROUNDS + 1):
        steps.append(f"""a{turn} AS (
    SELECT r, arg_min(c, d * 1000 + c) AS c, min(d) AS d
    FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
          FROM kept, c{turn})
    GROUP BY r
)""")
        if turn < heap_kmeans.ROUNDS:
            steps.append(f"""c{turn + 1} AS (
    SELECT c, coalesce(n, m) AS m FROM c{turn} LEFT JOIN (
        SELECT c, list(x ORDER BY i) AS n FROM (
            SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
            FROM (SELECT c, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM kept JOIN a{turn} USING (r))
            GROUP BY c, i)
        GROUP BY c) USING (c)
)""")
    last = heap_kmeans.ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a{last} USING (r) JOIN c{last} USING (c)
"""
    )


def _fields(text: str) -> str:
    return " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))


_CRC_ID = _crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))")
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
_A = manifest.ARITY
MANIFEST = rf"""
WITH RECURSIVE digests AS (
    SELECT doc_id, source, sha256({_fields("text")}) AS leaf,
           CASE WHEN {_CRC_ID} % 5 = 0 THEN sha256({_fields(_LOWERED)}) END AS shown
    FROM documents
),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS width,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM digests
),
nodes AS (
    SELECT tree, 0 AS level, pos, width, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // {_A}, (width + {_A - 1}) // {_A}, sha256(string_agg(digest, '' ORDER BY pos))
    FROM nodes WHERE width > 1 GROUP BY tree, level, pos // {_A}, width
),
subroots AS (SELECT tree AS pos, digest, count(*) OVER () AS width FROM nodes WHERE width = 1),
top AS (
    SELECT 0 AS level, pos, width, digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // {_A}, (width + {_A - 1}) // {_A}, sha256(string_agg(digest, '' ORDER BY pos))
    FROM top WHERE width > 1 GROUP BY level, pos // {_A}, width
),
every AS (
    SELECT tree, level, pos, width, digest FROM nodes WHERE width > 1
    UNION ALL
    SELECT -1, level + 100, pos, width, digest FROM top
),
-- A path goes up its own tree, then from level 100 up the tree of subroots.
path AS (
    SELECT tree AS own, pos AS row, tree AS at, CASE WHEN width > 1 THEN 0 ELSE 100 END AS level,
           CASE WHEN width > 1 THEN pos ELSE tree END AS pos, width AS w, coalesce(shown, leaf) AS digest, '' AS siblings
    FROM leaves
    UNION ALL
    SELECT p.own, p.row, p.at,
           CASE WHEN p.level < 100 AND n.width <= {_A} THEN 100 ELSE p.level + 1 END,
           CASE WHEN p.level < 100 AND n.width <= {_A} THEN p.own ELSE p.pos // {_A} END,
           n.width,
           sha256(string_agg(CASE WHEN n.pos = p.pos THEN p.digest ELSE n.digest END, '' ORDER BY n.pos)),
           p.siblings || coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos <> p.pos), '')
    FROM path p JOIN every n
      ON n.tree = CASE WHEN p.level < 100 THEN p.at ELSE -1 END AND n.level = p.level AND n.pos // {_A} = p.pos // {_A}
    WHERE n.width > 1
    GROUP BY p.own, p.row, p.at, p.level, p.pos, p.digest, p.siblings, n.width
),
ends AS (SELECT own, row, digest, siblings FROM path QUALIFY row_number() OVER (PARTITION BY own, row ORDER BY level DESC) = 1),
root AS (SELECT digest AS root FROM top WHERE width = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.root, sha256(e.siblings) AS proof_sha256, e.digest AS folded_root,
       e.digest = r.root AS verified
FROM leaves l JOIN ends e ON e.own = l.tree AND e.row = l.pos JOIN subroots s ON s.pos = l.tree CROSS JOIN root r
"""


_HOST = "translate(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')"
_PATH = "regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_RULES = ", ".join(
    f"({_quoted(r[: r.index('/')])}, {_quoted(r[r.index('/') :])}, {_quoted(r)}, {_quoted(v)})" for r, v in url_filter.RULES
)
_BEST = """
    SELECT p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
    FROM {0} p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY ALL"""
# A turn adds a tolerance at most after so many; what comes later is below any difference that counts.
_TURNS = 90
URLS = rf"""
WITH RECURSIVE rules(host, path, rule, verdict) AS (VALUES {_RULES}),
placed AS (SELECT page_id, html, {_HOST.format("coalesce(url, '')")} AS host, {_PATH.format("coalesce(url, '')")} AS path FROM pages),
linked AS (
    SELECT host AS src, {_HOST.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst
    FROM (SELECT host, unnest(regexp_extract_all(html, {_quoted(url_filter.LINK)}, 1)) AS link FROM placed)
),
edges AS (
    SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share
    FROM linked WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
),
on_pages AS (SELECT host, path, count(*) AS n FROM placed WHERE host <> '' GROUP BY ALL),
alone AS (SELECT DISTINCT dst AS host, '/' AS path, 1 AS n FROM edges WHERE dst NOT IN (SELECT host FROM on_pages)),
places AS (FROM on_pages UNION ALL FROM alone),
fits AS ({_BEST.format("places")}),
seeds AS (
    SELECT host, coalesce(sum(n) FILTER (verdict = 'allow'), 0) / sum(n) AS allow,
           coalesce(sum(n) FILTER (verdict = 'block'), 0) / sum(n) AS block
    FROM places LEFT JOIN fits USING (host, path) GROUP BY host
),
trust AS (
    SELECT 0 AS turn, host, allow::DOUBLE AS gain FROM seeds WHERE allow > 0
    UNION ALL
    SELECT turn + 1, dst, sum({url_filter.DAMPING} * gain * share) FROM trust JOIN edges ON src = host
    WHERE turn < {_TURNS} GROUP BY turn, dst
),
distrust AS (
    SELECT 0 AS turn, host, block::DOUBLE AS gain FROM seeds WHERE block > 0
    UNION ALL
    SELECT turn + 1, src, sum({url_filter.DAMPING} * gain * share * (1 - coalesce(block, 0)))
    FROM distrust d JOIN edges ON dst = d.host LEFT JOIN seeds s ON s.host = src
    WHERE turn < {_TURNS} GROUP BY turn, src
),
scores AS (
    SELECT host, sum(d) - sum(t) AS excess
    FROM (SELECT host, gain AS t, 0 AS d FROM trust UNION ALL SELECT host, 0, gain FROM distrust) GROUP BY host
)
SELECT page_id, placed.host, placed.path, rule,
       coalesce(verdict, CASE WHEN excess > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM placed LEFT JOIN fits USING (host, path) LEFT JOIN scores USING (host)
"""

ORACLE = {
    "op4_jaccard_join": JACCARD,
    "op5_exact_dedup": EXACT,
    "op6_license_scan": LICENSES,
    "op7_substring_dedup": SUBSTRINGS,
    "op8_embedding_dedup": VECTORS,
    "op10_url_filter": URLS,
    "op11_fingerprints": FINGERPRINTS,
    "op12_heap_kmeans": _kmeans(),
    "op13_manifest": MANIFEST,
}
