"""Trust and distrust on graphs, against a plain solution of the same equations."""

import random
from collections import Counter, defaultdict

import pytest

from tillhouse.llm.url_filter import DAMPING, THRESHOLD, filter_urls

LINK = '<a href="{}">x</a>'


def judged(spark, pages):
    rows = [(n, f"http://{host}{path}", "".join(map(LINK.format, links))) for n, (host, path, links) in enumerate(pages)]
    found = filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    return {r.host: r for r in found}


def plain(pages):
    """Trust and distrust per host by 400 rounds over all hosts."""
    links, own = defaultdict(Counter), defaultdict(list)
    for host, path, targets in pages:
        own[host].append("block" if host.endswith(".net") else "allow" if host.endswith(".org") and path.startswith("/fr/") else None)
        for target in targets:
            other = target.split("/")[2]
            if other != host:
                links[host][other] += 1
    for target in {t for c in links.values() for t in c} - set(own):
        own[target].append("block" if target.endswith(".net") else None)
    share = {h: {t: n / sum(c.values()) for t, n in c.items()} for h, c in links.items()}
    part = lambda h, v: sum(x == v for x in own[h]) / len(own[h])
    trust = {h: part(h, "allow") for h in own}
    distrust = {h: part(h, "block") for h in own}
    for _ in range(400):
        given = {h: part(h, "allow") for h in own}
        for h, c in share.items():
            for t, s in c.items():
                given[t] += DAMPING * trust[h] * s
        trust = given
        distrust = {
            h: part(h, "block") + (1 - part(h, "block")) * DAMPING * sum(s * distrust[t] for t, s in share.get(h, {}).items())
            for h in own
        }
    return trust, distrust


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{n}.{end}" for n in range(14) for end in ("net", "org", "info", "info")]
    pages = [
        (rng.choice(hosts), rng.choice(["/fr/1", "/a", "/"]), [f"http://{rng.choice(hosts)}/x" for _ in range(rng.randrange(6))])
        for _ in range(150)
    ]
    found = judged(spark, pages)
    trust, distrust = plain(pages)
    for host, row in found.items():
        assert row.trust == pytest.approx(trust[host], abs=0.01), host
        assert row.distrust == pytest.approx(distrust[host], abs=0.01), host
        excess = distrust[host] - trust[host]
        if row.rule is None and abs(excess - THRESHOLD) > 0.02:
            assert row.verdict == ("block" if excess > THRESHOLD else "allow"), host


def test_one_bad_link_in_a_hundred_and_link_farms(spark):
    good = [f"http://good{n}.info/" for n in range(99)]
    pages = [
        ("clean.info", "/", [*good, "http://bad.net/"]),
        ("fan.info", "/", ["http://clean.info/"]),
        ("farm.info", "/", ["http://bad.net/", "http://worse.net/a", "http://good1.info/"]),
        ("outer.info", "/", ["http://farm.info/"]),
        ("www.example.com", "/en/1", []),
        ("shop.example.com", "/de/1", []),
    ]
    pages += [("www.example.com", f"/{p}/1", []) for p in ("de", "fr", "es")]
    found = judged(spark, pages)
    verdict = {h: r.verdict for h, r in found.items() if r.rule is None}
    assert verdict["clean.info"] == verdict["fan.info"] == "allow"
    assert verdict["farm.info"] == verdict["outer.info"] == "block"
    # One of its four pages is blocked by a rule: no reason to block the others.
    rows = [(n, f"http://www.example.com/{p}/1", "") for n, p in enumerate(["en", "de", "fr", "es"])]
    out = filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.path: r.verdict for r in out} == {"/en/1": "allow", "/de/1": "block", "/fr/1": "allow", "/es/1": "allow"}


def test_long_paths_count(spark):
    pages = [(f"c{n}.info", "/", [f"http://c{n + 1}.info/"]) for n in range(20)] + [("c20.info", "/", ["http://bad.net/"])]
    found = judged(spark, pages)
    for n in range(21):
        assert found[f"c{n}.info"].distrust == pytest.approx(DAMPING ** (21 - n), abs=1e-3)


def test_trusted_links_outweigh(spark):
    pages = [(f"seed{n}.org", "/fr/1", ["http://known.info/"]) for n in range(3)]
    pages.append(("known.info", "/", ["http://bad.net/"]))
    assert judged(spark, pages)["known.info"].verdict == "allow"
