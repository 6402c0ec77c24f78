"""WARC, HTML extraction, URL filter, page language."""

import base64
import hashlib

import pytest

from cairnmine.llm import html_extract, language_id, queries, sql, url_filter, warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n tail"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("split", ["300", "100m"])
def test_warc_round_trip(spark, split):
    rows = [(1, "u", FAKE), (2, "u2", FAKE), (3, None, None), (4, "x\r\ny", ""), (5, "l", "a" * 5000 + "WARC/1.1\r\n" + "b" * 3000), (None, "n", "no id"), (6, "m", "é\r\n\r\nWARC/1.1\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n"), (7, "d", "d"), (7, "d", "d"), (8, "e", "d")]
    df = pages(spark, rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.round_trip(df.repartition(2)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == raw and j is not None]
        first = max(same, default=None)
        revisit = first is not None and i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_warc_smaller_payloads_are_all_response(spark):
    got = warc.round_trip(pages(spark, [(1, "a", "xy"), (2, "a", "xy"), (3, "a", "long enough"), (4, "a", "long enough")]), least=5).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_empty(spark):
    assert warc.round_trip(pages(spark, [(1, "a", "b")]).where("false")).count() == 0


CASES = [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"),
    ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One <b>two</b>\n three<br>four</p><p>Short.</p><script>var x='<p>no</p>'</script></article><footer>f</footer></body></html>", "Head\n\nOne two three four\n\nShort."),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Body &eacute;&#233;&nbsp;x</p><form><p>Name</p></form><aside>side</aside></main><section id=comments><p>great post, a long comment that says many things about it</p></section>", "Body éé x"),
    ("<div class='site-header'>Site</div><article><header class='article-header'><h1>Title</h1><p class='byline'>By A</p></header><p>Text</p><div class='article-comments'><p>reader says</p></div><footer>tags</footer></article><div class='alert'>note</div>", "Title\n\nBy A\n\nText"),
    ("<article><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table></article>", "a\n\nb\n\nc\n\nd\n\ne\n\nf"),
    ("<article><p>cut off <a hre", "cut off"), ("<article><p>x<!-- never closed <p>y", "x"), ("<article>a < b <3 c</article>", "a < b <3 c"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_main_text(html, want):
    assert html_extract.main_text(html) == want


def test_long_page_is_whole():
    body = "".join(f"<p>paragraph number {i}</p>" for i in range(5000))
    got = html_extract.main_text(f"<body><nav>n</nav><article>{body}</article></body>")
    assert got.split("\n\n") == [f"paragraph number {i}" for i in range(5000)]


def test_min_cut_against_all_labellings():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        price = lambda s: sum(c for c, x in zip(cost, s) if c > 0 and not x) - sum(c for c, x in zip(cost, s) if c < 0 and x) + sum(w for i, j, w in edges if s[i] != s[j])  # noqa: E731, B023
        best = min(price(s) for s in itertools.product((False, True), repeat=n))
        assert abs(price(html_extract.min_cut(cost, edges)) - best) < 1e-9


def signs_and_labels(html):
    found = html_extract.blocks(html)
    return {b.text: (b.cost > 0, kept) for b, kept in zip(found, html_extract.min_cut([b.cost for b in found], html_extract.smoothness(found)))}


LONG = "A sentence of an article that goes on for a while, so that nobody takes it for a label. " * 2


def test_cut_overrules_a_block_both_ways():
    got = signs_and_labels(f"<div><p>{LONG}1</p><p><a href=x>A figure</a></p><p>{LONG}2</p></div>")
    assert got["A figure"] == (False, True) and all(kept for _, kept in got.values())
    got = signs_and_labels("<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li>You are here</li><li><a href=c>Four</a></li><li><a href=d>Five</a></li></ul>")
    assert got["You are here"] == (True, False) and not any(kept for _, kept in got.values())


PAGES = [  # (html, content, not content)
    (f"<article><p>{LONG}</p><div class='social-history'>How people lived then.</div><p>{LONG}</p></article>", ["How people lived then."], []),
    (f"<div class='xx'>Buy our shoes today, they are cheap.</div><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><div class='bottom'>All rights reserved</div>", ["T"], ["Buy our shoes today, they are cheap.", "All rights reserved"]),
    (f"<div id=w><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class='q'>\u00a9 2020 Somebody</div><div><p>We use cookies on this site</p></div>", ["Head"], ["\u00a9 2020 Somebody", "We use cookies on this site"]),
    (f"<article><p>{LONG}</p><div class='ad-slot-3'>{LONG}ad</div><p>{LONG}</p><footer>Filed under things</footer><section class='user-comments'><p>{LONG * 3}reader</p></section></article>", [], [f"{LONG}ad", "Filed under things", f"{LONG * 3}reader"]),
    (f"<main><div class='post-content'><p>{LONG}</p><ul><li>First point</li><li>Second point</li></ul></div></main><aside><p>{LONG}side</p></aside>", ["First point", "Second point"], [f"{LONG}side"]),
]


@pytest.mark.parametrize("html,content,rest", PAGES)
def test_pages_without_tell_tale_names(html, content, rest):
    got = html_extract.main_text(html).split("\n\n")
    assert all(x.strip() in got for x in content) and LONG.strip() in got and not any(x.strip() in got for x in rest)


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>x", 9, "a"), (1, "u", "<p>x", 9, "a"), (None, None, None, None, None), (2, "v", "", 0, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")  # clashing names
    got = sorted(tuple(r) for r in html_extract.extract(df).fillna({"page_id": 0, "url": "-"}).collect())
    assert got == [(0, "-", "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (2, "v", "", 0)]
    assert html_extract.extract(df.where("false")).count() == 0


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
        path = rest[k:].split("?")[0].split("#")[0] if rest[k : k + 1] == "/" else ""
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max((r for r in queries.RULES if fits(*r[:2])), key=lambda r: len(r[0] + r[1]), default=None)
    if best:
        return host, path, best[0] + best[1], best[2]
    return host, path, None, "block" if any(fits(*x) for x in queries.LISTED) else "allow"


def test_url_filter_against_plain_rules(spark):
    urls = [None, "", "nope", "http://a.com/en/1", "http://example.com/en/7x", "HTTP://WWW.Example.COM/en/70?q#f", "http://xexample.com/en/7", "https://example.net/de/8", "https://example.net/de/9", "https://n.org/es/", "https://n.org", "https://n.org?x=/es/", "https://n.org#/es/", "http://spam-farm.example.org/z", "http://casino-win.example.org", "http://user@a.net/de/1", "ftp://net/de/", "x://a://b/en/", "http://com/en/", "http://org.", "http://..com/en/"]
    df = spark.createDataFrame([(k, u, "old", 1) for k, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string, block int")
    rules, listed = spark.createDataFrame(queries.RULES, "host string, path string, verdict string"), spark.createDataFrame(queries.LISTED, "host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, listed).collect()}
    assert got == {k: plain_verdict(u) for k, u in enumerate([*urls, urls[3]])}
    none = url_filter.judge(df, rules.where("false")).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(urls) + 1
    assert url_filter.judge(df.where("false"), rules, listed).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    rows = [(1, "http://a.com/en/1"), (2, "http://www.example.com/en/7"), (3, "http://a.net/de/1"), (4, "http://example.net/de/8"), (5, "http://example.net/de/9"), (6, "http://a.org/es/1")]
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("net/de/", "allow"), 6: ("org/es/", "block")}


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.com') host", "concat('/p', id) path")
    df = spark.range(6000).selectExpr("id page_id", "concat('http://www.h', id, '.com/p', id, '/x') url")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = url_filter.judge(df, rules, listed)
    assert got.where("page_id < 3000 and verdict = 'block'").count() == 3000 and got.where("page_id >= 3000 and verdict = 'allow'").count() == 3000


def test_page_language(spark):
    texts = {"en": "the cat and the dog of the house with that thing", "de": "der hund und die katze sind nicht mit dem haus", "fr": "le chat et la maison de la ville avec les gens"}
    rows = [(i, f"http://{'hot' if i % 3 else l}.example.{l}/x", f"<html lang='{l}-XX'><body><p>{(t + ' ') * 5} {i}</p></body></html>") for i, (l, t) in enumerate(list(texts.items()) * 20)]
    rows += [(900, None, None), (901, "http://hot.example.de/", "<p></p>")]
    got = {r.id: r for r in language_id.identify(language_id.of_pages(pages(spark, rows))).collect()}
    assert all(got[i].lang == l and got[i].accepted for i, (l, _) in enumerate(list(texts.items()) * 20))
    assert not got[900].accepted and not got[901].accepted


def test_sql_is_for_queries():
    assert set(sql.SQL) <= set(queries.queries())
