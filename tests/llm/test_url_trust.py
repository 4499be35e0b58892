import re

import pytest

from storyloom.llm import url_trust

RULES = {"com/": ("allow", "com", "/"), "example.com/en/": ("block", "example.com", "/en/"), "www.example.com/en/": ("allow", "www.example.com", "/en/"), "net/es/": ("block", "net", "/es/"), "net/fr/": ("block", "net", "/fr/")}
SCHEMA = "page_id long, url string, html string, host string, mass double"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule(host, path):
    fit = [k for k, (_, h, p) in RULES.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=len) if fit else None


URLS = [
    "http://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "https://example.com/enx", "http://x.net/es/1", "http://net/fr/", "http://notexample.com/en/",
    "http://x.net/de/1", "http://y.org", "http://y.org?x=/a", "http://y.org#f", "no scheme", None, "", "ftp://h/p://q", "http:///p", "http://B.NET/ES/x", "http://b.net/\nes/",
]


def test_host_path_and_rule(spark):
    rows = [(i, u, None, "junk", 1.0) for i, u in enumerate(URLS)]
    out = {r.page_id: r for r in url_trust.judge_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, u in enumerate(URLS):
        host, path = split(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule(host, path)), u
        if out[i].rule:
            assert out[i].verdict == RULES[out[i].rule][0]
        else:
            assert out[i].verdict in ("allow", "block")
    assert out[11].verdict == "allow"


def test_rank_against_brute_force(spark):
    links = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("d", "c", 1)]
    seeds = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.5}
    edges = spark.createDataFrame(links, "src string, dst string, n long")
    got = {r.host: r.mass for r in url_trust.personalised_rank(edges, spark.createDataFrame(list(seeds.items()), "host string, seed double"), rounds=5).collect()}
    mass = dict(seeds)
    for _ in range(5):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for a, b, n in links:
            new[b] += 0.85 * mass[a] * n / sum(x[2] for x in links if x[0] == a)
        mass = new
    assert got == pytest.approx(mass)


def test_distrust_flows_back_to_who_links_there(spark):
    to = lambda *hosts: "".join(f'<a href="http://{h}/p">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/es/", None), (2, "http://bad.net/fr/1", None), (3, "http://farm.org/", to("bad.net")), (4, "http://good.com/", to("friend.org")), (5, "http://friend.org/", None), (6, "http://alone.org/", to("nowhere.org"))]
    out = {r.page_id: r.verdict for r in url_trust.judge_pages(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()}
    assert [out[i] for i in range(1, 7)] == ["block", "block", "block", "allow", "allow", "allow"]


def test_repeated_rows_and_empty(spark):
    rows = [(1, "http://y.net/es/", "<a href=//z.org>", None, None)] * 3
    assert url_trust.judge_pages(spark.createDataFrame(rows, SCHEMA)).count() == 3
    assert url_trust.judge_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distrust_settles_over_long_chains(spark):
    to = lambda host: f'<a href="http://{host}/p">x</a>'
    rows = [(0, "http://bad.net/es/", None), (1, "http://h1.org/", to("bad.net"))] + [(i, f"http://h{i}.org/", to(f"h{i - 1}.org")) for i in range(2, 13)]
    out = {r.page_id: r.verdict for r in url_trust.judge_pages(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()}
    assert [out[i] for i in range(13)] == ["block"] * 5 + ["allow"] * 8


def test_ranks_of_a_cycle_are_settled(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "src string, dst string, n long")
    got = {r.host: r.mass for r in url_trust.personalised_rank(edges, spark.createDataFrame([("a", 1.0)], "host string, seed double"), damping=0.5).collect()}
    assert got == pytest.approx({h: 0.5 * 0.5**k / (1 - 0.5**3) for k, h in enumerate("abc")}, abs=1e-5)
