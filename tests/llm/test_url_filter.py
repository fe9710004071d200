from collections import Counter, defaultdict

import pytest

from leakscope.llm import url_filter as u
from leakscope.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, html string, host string, rule int, match string"


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)


PAGES = [
    (1, "http://good.org/", link("mid.net", "Mid.NET", "far.net")),
    (2, "http://mid.net/a?b", link("far.net", "good.org", "mid.net")),
    (3, "http://spam.net/q", link("x.com", "x.com", "far.net")),
    (4, "http://x.com/de/1#f", link("spam.net")),
    (5, "http://x.com/en/1", '<a href=//quiet.net/z>'),
    (6, None, link("far.net")),
    (7, "no address", None),
    (8, "HTTP://A.Example.ORG/es/1", ""),
    (8, "HTTP://A.Example.ORG/es/1", ""),
    (9, "https://example.org/en/12", None),
    (10, "https://notexample.org?x=/es/", None),
    (11, "ftp://user@x.com:80/fr/", None),
    (None, "http://far.net/", None),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "own", 1, "own") for r in rows], SCHEMA)


def brute_spread(links, seeds, kind):
    edges = {(a, b): w for (a, b), w in links.items()} if kind == 0 else {(b, a): w for (a, b), w in links.items()}
    given = Counter()
    for (a, _), w in edges.items():
        given[a] += w
    seeds = {h: float(s[kind]) for h, s in seeds.items() if s[kind]}
    scores, whole = dict(seeds), sum(seeds.values())
    for _ in range(u.MOST_ROUNDS):
        new = defaultdict(float)
        for (a, b), w in edges.items():
            new[b] += u.DAMPING * scores.get(a, 0) * w / given[a]
        rest = (whole - sum(new.values())) / whole
        for h, s in seeds.items():
            new[h] += s * rest
        scores = new
    return scores


def test_scores_match_brute_force(spark):
    links = {("good.org", "mid.net"): 2, ("mid.net", "far.net"): 1, ("mid.net", "good.org"): 1, ("spam.net", "x.com"): 2, ("x.com", "spam.net"): 1, ("far.net", "dead.net"): 5}
    seeds = {"good.org": (3, 0), "x.com": (1, 4), "lone.net": (0, 2)}
    found = u.spread(
        spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src string, dst string, weight bigint"),
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust bigint, distrust bigint"),
    ).collect()
    trust, distrust = brute_spread(links, seeds, 0), brute_spread(links, seeds, 1)
    for r in found:
        assert r.trust == pytest.approx(trust.get(r.host, 0), abs=1e-4)
        assert r.distrust == pytest.approx(distrust.get(r.host, 0), abs=1e-4)
    assert {r.host for r in found} == set(trust) | set(distrust)


def test_verdicts(spark):
    found = u.judge_urls(table(spark), URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == len(PAGES)
    assert got[1] == ("good.org", "/", "org/", "allow") and got[2] == ("mid.net", "/a", None, "allow")
    assert got[4] == ("x.com", "/de/1", "com/de/", "block")
    assert got[3][3] == "block"  # it links to a blocked host
    assert got[6] == ("", "", None, "allow") == got[7]
    assert got[8] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[9][2:] == ("example.org/en/1", "block") and got[10] == ("notexample.org", "", None, "allow")
    assert got[11] == ("user@x.com:80", "/fr/", None, "allow") and got[None][3] == "allow"


def test_empty_table(spark):
    assert u.judge_urls(table(spark, []), URL_RULES).count() == 0


def test_rules_are_parsed():
    assert u.parse_rule("block com/de/") == u.UrlRule("block", "com", "/de/")
    assert u.parse_rule("allow org/").text == "org/"


def test_hosts_far_from_a_seed_are_reached(spark):
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(34)], "src string, dst string, weight bigint")
    seeds = spark.createDataFrame([("h0", 1, 0)], "host string, trust bigint, distrust bigint")
    trust = {r.host: r.trust for r in u.spread(links, seeds).collect()}
    first = (1 - u.DAMPING) / (1 - u.DAMPING**35)
    assert trust == pytest.approx({f"h{i}": first * u.DAMPING**i for i in range(35)}, abs=1e-4) and trust["h34"] > 0
