"""Rules against a plain reading, ranks against a matrix, and the verdicts of linked hosts."""

import random
import re

import numpy as np
import pytest
from conftest import values

from flightlens.llm import url_filters
from flightlens.llm.url_filters import RULES, Rule


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme.net/x", "http://", "https://A.Example.NET/en/1?x=/y#z", "http://net/", "http://x.net", "http://x.net?q", "http://internet/",
    "http://example.com/de/1", "http://notexample.com/de/", "http://m.example.com/DE/", "http://a.org/fr/x", "http://a.org/fr", "ftp://ÉX.Example.net/en/#", "x://y://z.net/a", "http://u@h.net:80/p",
]


def test_rules(spark, rows):
    df = rows("page_id long, url string, html string, host string", *[(i, u, None, "old") for i, u in enumerate(URLS)], (0, None, None, "old"))
    out = url_filters.judge_urls(df, iterations=1)
    assert out.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    for i, url in enumerate(URLS):
        want = plain(url)
        assert got[i][:3] == want[:3], url
        if want[2]:
            assert got[i][3] == want[3], url
    assert out.count() == len(URLS) + 1
    assert values(url_filters.judge_urls(df.limit(0), iterations=1)) == []


def test_longest_rule_wins_in_any_order(rows):
    df = rows("host string, path string", ("a.net", "/en/1"))
    for rules in (RULES, RULES[::-1]):
        longer = (*rules, Rule("allow", "a.net", "/en/"))
        assert df.select(url_filters.first_rule(df.host, df.path, longer)[0]).first()[0] == "a.net/en/"


def test_ranks_like_a_matrix(spark, rows):
    draw = np.random.default_rng(1)
    n, links = 8, [(a, b) for a in range(8) for b in range(8) if a != b and draw.random() < 0.3]
    matrix = np.zeros((n, n))
    for a in range(n):
        out = [b for x, b in links if x == a]
        for b in out or [a]:
            matrix[b, a] = 1 / len(out or [a])
    start = np.array([1, 2, 0, 0, 0, 0, 0, 1]) / 4
    rank = start
    for _ in range(6):
        rank = 0.85 * matrix @ rank + 0.15 * start
    edges = rows("src string, dst string, w double", *[(str(a), str(b), float(matrix[b, a])) for b in range(n) for a in range(n) if matrix[b, a]])
    hosts = rows("host string, seed double", *[(str(k), float(4 * x)) for k, x in enumerate(start)])
    got = {r.host: r["rank"] for r in url_filters.pagerank(edges, hosts, iterations=6, damping=0.85, name="test").collect()}
    assert [got[str(k)] for k in range(n)] == pytest.approx(rank.tolist())


def exact_verdicts(links, allowed, denied, least=0.1):
    """Ranks as solutions of linear equations: with the links from trusted hosts, against them from blocked ones."""
    hosts = sorted({h for pair in links for h in pair} | set(allowed) | set(denied))
    at = {h: k for k, h in enumerate(hosts)}

    def ranks(edges, seeds):
        m = np.zeros((len(hosts), len(hosts)))
        for a, b in edges:
            m[at[b], at[a]] += 1
        for k in range(len(hosts)):
            if not m[:, k].any():
                m[k, k] = 1
        start = np.array([float(h in seeds) for h in hosts])
        return np.linalg.solve(np.eye(len(hosts)) - 0.85 * m / m.sum(axis=0), 0.15 * start / start.sum())

    trust, distrust = ranks(links, allowed), ranks([(b, a) for a, b in links], denied)
    return {h: bool(distrust[k] > trust[k] and distrust[k] * len(hosts) >= least) for h, k in at.items()}


def test_hosts_near_blocked_seeds_are_blocked(spark, rows):
    to = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    pages = [
        ("http://bad.net/1", to("worse.example")),
        ("http://spam.example/1", to("bad.net", "bad2.net")),
        ("http://bad2.net/1", None),
        ("http://good.org/fr/1", to("friend.example", "Other.example")),
        ("http://friend.example/", to("good.org")),
        ("http://lonely.example/", "<p>no links</p>"),
        ("http://mixed.example/", to("bad.net", "good.org", "friend.example")),
    ]
    df = rows("page_id long, url string, html string", *[(k, u, h) for k, (u, h) in enumerate(pages)])
    got = {r.host: r.verdict for r in url_filters.judge_urls(df).collect()}
    assert got == {
        "bad.net": "block", "bad2.net": "block", "spam.example": "block",
        "good.org": "allow", "friend.example": "allow", "lonely.example": "allow", "mixed.example": "block",
    }
    links = [(u.split("/")[2], h.lower()) for u, x in pages for h in re.findall("https://([^/]+)", x or "")]
    want = exact_verdicts(links, {"good.org"}, {"bad.net", "bad2.net"})
    assert all((got[h] == "block") == want.get(h, False) for h in got if h not in ("bad.net", "bad2.net", "good.org"))


def test_verdicts_of_random_graphs(spark, rows):
    """The thresholds, on graphs where many hosts lie between trusted and blocked ones."""
    for seed in (1, 2):
        draw = random.Random(seed)
        hosts = [f"h{k}.example" for k in range(25)] + ["a.net", "b.net", "c.org", "d.org"]
        links = sorted({(a, b) for a in hosts for b in draw.sample(hosts, 3) if a != b and draw.random() < 0.7})
        pages = [(k, f"http://{h}/fr/", "".join(f'<a href="http://{b}/">x</a>' for a, b in links if a == h)) for k, h in enumerate(hosts)]
        got = {r.host: r.verdict for r in url_filters.judge_urls(rows("page_id long, url string, html string", *pages)).collect()}
        want = exact_verdicts(links + [(h, h) for h in hosts if not any(h in x for x in links)], {"c.org", "d.org"}, {"a.net", "b.net"})
        assert {h: v == "block" for h, v in got.items() if h.endswith(".example")} == {h: v for h, v in want.items() if h.endswith(".example")}
        assert len(set(want.values())) == 2


def test_hosts_at_the_end_of_a_long_chain_are_blocked(spark, rows):
    hosts = ["bad.net", *(f"h{k}.example" for k in range(1, 13))]
    pages = [(k, f"http://{h}/1", f'<a href="http://{hosts[k - 1]}/">x</a>' if k else None) for k, h in enumerate(hosts)]
    df = rows("page_id long, url string, html string", *pages)
    assert {r.host: r.verdict for r in url_filters.judge_urls(df).collect()} == dict.fromkeys(hosts, "block")
