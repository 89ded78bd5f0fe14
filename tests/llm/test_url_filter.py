"""URL rules, host and path, and scores over the link graph."""

from __future__ import annotations

import re

import duckdb
import pytest

from eventlens.llm.queries import ORACLES, QUERIES, URL_RULES
from eventlens.llm.url_filter import filter_urls, propagate
from tests.llm import plain

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM", "http://example.com/en/x?q", "http://a.example.com/en/",
    "http://www.example.com/en/1#f", "http://net/es/", "http://x.net/fr/a?b", "http://x.net/de/", "http://xnet/es/1",
    "http://com/", "http://com", "a://b://c/d", "http://h.org?x=/en/", "http://h.org#y", "http://ÄB.com/É\n/x", "http://h.org/a\nb?c",
]


def plain_rule(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (plain.ascii_lower(match[1]), match[2]) if match else ("", "")
    fits = [
        (len(h + p), h + p, v) for v, h, p in URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_on_odd_urls(spark):
    rows = [(i, u, None, "x") for i, u in enumerate(URLS)] + [(5, URLS[5], "", "x"), (None, "http://x.net/es/", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = plain.rows_of(filter_urls(pages, URL_RULES), "page_id", "host", "path", "rule", "rule_verdict")
    assert got == sorted(((i, *plain_rule(u)) for i, u, *_ in rows), key=str)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert filter_urls(empty, URL_RULES).collect() == []
    assert {r["verdict"] for r in filter_urls(pages, []).collect()} == {"allow"}


def test_trust_and_distrust_follow_links(spark):
    rules = [("allow", "good.org", "/"), ("block", "bad.org", "/")]
    link = lambda *hosts: " ".join(f'<a HREF="http://{h}/x">x</a>' for h in hosts)
    rows = [
        (1, "http://good.org/", link("friend.org")), (2, "http://bad.org/", link("other.org")),
        (3, "http://friend.org/", '<a href=//mixed.org>'), (4, "http://farm.org/", link("bad.org", "bad.org", "other.org")),
        (5, "http://farm2.org/", link("farm.org")), (6, "http://mixed.org/", link("bad.org")), (7, "http://other.org/", "/local"),
    ]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {
        1: "allow", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow",
    }
    assert got[3]["trust"] == pytest.approx(0.15 * 0.85)
    assert got[6]["trust"] == pytest.approx(0.15 * 0.85**2) and got[6]["distrust"] == pytest.approx(0.15 * 0.85 / 3)
    # a blocked host hands trust on like any other, but nobody's distrust comes from being linked
    assert got[7]["trust"] == pytest.approx(0.15 * 0.85**4) and got[7]["distrust"] == 0


def test_scores_against_plain_walk(spark):
    edges = [("t", "a", "b", 2), ("t", "a", "c", 1), ("t", "b", "a", 1), ("t", "c", "c2", 4), ("d", "b", "a", 1)]
    seeds = [("t", "a", 0.5), ("t", "c", 0.5), ("d", "b", 1.0)]
    want = dict.fromkeys({(k, h) for k, h, _ in seeds}, 0.0)
    total: dict = {}
    for k, a, _, n in edges:
        total[k, a] = total.get((k, a), 0) + n
    scores = {(k, h): 0.15 * s for k, h, s in seeds}
    for _ in range(7):
        nxt = {(k, h): 0.15 * s for k, h, s in seeds}
        for k, a, b, n in edges:
            nxt[k, b] = nxt.get((k, b), 0) + 0.85 * n / total[k, a] * scores.get((k, a), 0)
        scores = nxt
    got = propagate(
        spark.createDataFrame(edges, "kind string, a string, b string, links long"),
        spark.createDataFrame(seeds, "kind string, host string, seed double"), rounds=7,
    )
    got = {(r["kind"], r["host"]): r["score"] for r in got.collect()}
    assert set(want) <= set(got) and got == pytest.approx({k: v for k, v in scores.items() if k in got})
    assert sum(v for (k, _), v in got.items() if k == "t") <= 1


def test_query_rows(spark, sf):
    got = QUERIES["op4_url_filter"](spark, sf)
    urls = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    want = sorted(((r["page_id"], *plain_rule(r["url"])[:3]) for r in urls), key=str)
    assert plain.rows_of(got, "page_id", "host", "path", "rule") == want


def test_chains_longer_than_ten_hosts(spark):
    """A farm chain to a blocked host, and a ring, against a walk that goes on until nothing moves."""
    rules = [("allow", "good.org", "/"), ("block", "bad.org", "/")]
    chain = [*[f"farm{i}.org" for i in range(14)], "bad.org"]
    links = [*zip(chain, chain[1:], strict=False), ("good.org", "r0.org"), *[(f"r{i}.org", f"r{(i + 1) % 3}.org") for i in range(3)], ("r1.org", "bad.org")]
    hosts = sorted({h for pair in links for h in pair})
    html = {h: " ".join(f'<a href="http://{b}/">x</a>' for a, b in links if a == h) for h in hosts}
    rows = [(i, f"http://{h}/", html[h]) for i, h in enumerate(hosts)]
    got = {r["host"]: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    for kind, seed, pairs in (("trust", "good.org", links), ("distrust", "bad.org", [(b, a) for a, b in links])):
        total = {h: sum(a == h for a, _ in pairs) for h in hosts}
        scores = dict.fromkeys(hosts, 0.0)
        for _ in range(400):
            scores = {h: 0.15 * (h == seed) + sum(0.85 * scores[a] / total[a] for a, b in pairs if b == h) for h in hosts}
        assert {h: r[kind] for h, r in got.items()} == pytest.approx(scores, rel=1e-7, abs=0)
    assert {got[h]["verdict"] for h in chain} == {"block"}


def test_sql_of_the_query_on_chains_and_rings(spark, tmp_path):
    """Hosts with no rule are judged by links alone, over more than ten hosts and round in circles."""
    chain = [*[f"farm{i}.org" for i in range(13)], "bad.net"]
    links = [
        *zip(chain, chain[1:], strict=False), ("seed.com", "r0.org"), ("r0.org", "r1.org"), ("r1.org", "r2.org"), ("r2.org", "r0.org"),
        ("r1.org", "bad.net"), ("farm3.org", "r2.org"), ("seed.com", "f.org"), ("f.org", "f2.org"),
    ]
    hosts = sorted({h for pair in links for h in pair})
    html = {h: " ".join(f'<a href="http://{b}/">x</a>' for a, b in links if a == h) for h in hosts}
    rows = [(i, f"http://{h}{'/es/' if h == 'bad.net' else '/'}", html[h]) for i, h in enumerate(hosts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    checked = con.sql(ORACLES["op4_url_filter"])
    names = [c[0] for c in checked.description]
    got = sorted(map(tuple, QUERIES["op4_url_filter"](spark, str(tmp_path)).select(*names).collect()))
    assert got == sorted(checked.fetchall())
    verdicts = dict(zip(hosts, (r[names.index("verdict")] for r in got), strict=True))
    assert {verdicts[h] for h in chain} == {"block"} and {verdicts[h] for h in ("r0.org", "r1.org", "f2.org")} == {"allow"}
