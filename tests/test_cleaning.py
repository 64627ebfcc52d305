"""Cleaning filters and discovery on inline HTML."""

import re
import time

import pytest
from pyspark.sql import functions as F

from feedloom.operators import cleaning as C
from feedloom.operators import discovery as D
from feedloom.operators.filter_list import DEFAULT_FILTERS, strip

PIXEL = '<img[^>]*width="1"[^>]*height="1"[^>]*>'


def clean(spark, filters, content="", link="http://a.com/1", title="T", **kwargs):
    df = spark.createDataFrame([("g", link, title, content)], "guid string, link string, title string, content string")
    return C.clean(df, filters, **kwargs).first()


@pytest.mark.parametrize("content,filters,expected", [
    ('<p>a</p><img src="x" width="1" height="1"><p>b</p>', [strip(PIXEL)], "<p>a</p><p>b</p>"),
    ('x<form action="/q"><input></form>y', [strip("<form.*?</form>", "si")], "xy"),
    ("<span><span></span></span>t", [strip("<span[^>]*></span>", "", "", True)], "t"),
    ("<span>" * 40 + "</span>" * 40 + "t", [strip("<span[^>]*></span>", "", "", True)], "t"),
    ("a<br>.<br>.<br>b", [strip("<br>[.>]<br>", "", "<br>", True)], "a<br>b"),
    ("a<br>" + ".<br>" * 99 + "b", [strip("<br>[.>]<br>", "", "<br>", True)], "a<br>b"),
    ("a" + "<br>\n" * 20000, [strip(r"(<br>\s*)+$")], "a"),
    ("a" + "<br> " * 20000 + "b", [strip(r"<br>\s*(<br>\s*)+", "", "<br>")], "a<br>b"),
    ("cost $1 \\x", [strip("cost", "", "$5")], "$5 $1 \\x"),
])
def test_strip(spark, content, filters, expected):
    assert clean(spark, filters, content)["content"] == expected


@pytest.mark.parametrize("content,filters,expected", [
    ("the " * 20000 + "b", [strip("the the ", "", "the ", True)], "the b"),
    ("a" * 300 + "b" * 300 + "c", [strip("ab", "", "", True)], "c"),
    ("xaab", [strip("a", "", "a", True)], "xaab"),
])
def test_repeated(spark, content, filters, expected):
    assert clean(spark, filters, content)["content"] == expected


def test_repeated_time(spark):
    """A repeated filter doesn't search a long text once a character."""
    texts = spark.range(200).selectExpr("'g' as guid", "'l' as link", "'t' as title", "concat('the the ', repeat('word ', 20000), id) as content")
    start = time.perf_counter()
    found = C.clean(texts, [strip("the the ", "", "the ", True)])
    assert found.where("content like 'the word %'").count() == 200
    assert time.perf_counter() - start < 60


def test_limit(spark):
    spec = ("limit", "example.com", strip("<form.*?</form>", "si"))
    html = "x<form></form>y"
    assert clean(spark, [spec], html, link="http://other.org/1")["content"] == html
    assert clean(spark, [spec], html, link="http://example.com/1")["content"] == "xy"


def test_links_and_titles(spark):
    assert clean(spark, None, link="http://xkcd.com/5")["link"] == "http://m.xkcd.com/5"
    assert clean(spark, None, link="http://go.theregister.com/feed/http://r.com/1")["link"] == "http://r.com/1"
    assert clean(spark, [("title", r"\1", "<h1>(.*?)</h1>", "")], "<h1>Real</h1>", title="Untitled")["title"] == "Real"
    assert clean(spark, [("title", r"\1", "<h1>(.*?)</h1>", "")], "<h1>Real</h1>", title="Kept")["title"] == "Kept"
    first = [("first_link", "http://a.com/")]
    assert clean(spark, first, '<a href="http://b.com/x">', link="http://a.com/#1")["link"] == "http://b.com/x"
    by_content = [("link", r"http://n/\1", None, r'id="(\d+)"')]
    assert clean(spark, by_content, 'x id="7"')["link"] == "http://n/7"


def test_dereference(spark):
    items = spark.createDataFrame([("g", "http://known/1")], "item_guid string, item_link string")
    pages = spark.createDataFrame([("http://digg.com/1", '<h3 id="title1"><a href="http://page/1">')], "url string, html string")
    spec = [("dereference", "digg.com", '<h3 id="title1"><a href="([^"]*)"')]
    none = items.limit(0)
    assert clean(spark, spec, link="http://digg.com/1", items=items, pages=pages)["link"] == "http://known/1"
    assert clean(spark, spec, link="http://digg.com/1", items=none, pages=pages)["link"] == "http://page/1"
    assert clean(spark, spec, link="http://digg.com/2", items=none, pages=pages)["link"] == "http://digg.com/2"
    assert clean(spark, spec, link="http://else/1", items=items, pages=pages)["link"] == "http://else/1"


def test_default_list():
    kinds = [f[0] for f in DEFAULT_FILTERS]
    assert len(kinds) == 122 and kinds.count("strip") == 112


def test_required_literal_is_required():
    """Texts built from each pattern match it and hold its literal."""
    samples = {
        '<a href="http://www.bloglines.com/sub/.*?</a>': '<a href="http://www.bloglines.com/sub/1">s</a>',
        '<a href="http://www.facebook.com/sharer?.php.*?</a>': '<a href="http://www.facebook.com/share.php">s</a>',
        '(<p>)?<a[^>]*href="http://[a-z]*ads.googleadservices[^>]*>[^<>]*<img [^<>]*></a>(</p>)?':
            '<a href="http://xads.googleadservices"><img x></a>',
        r'\s*(<br>)?<p>\s*<br>\s*</p>\s*': "<p><br></p>",
        r'<hr\s?/?>\s*<a href="http://pro.gigaom.com/.*</a>': '<hr><a href="http://pro.gigaom.com/">x</a>',
        '(<br>)*<img[^>]*triggit.com.*?>': '<img src="triggit.com">',
        '<p [^>]*></p>': "<p a></p>",
    }
    for pattern, text in samples.items():
        literal = C.required_literal(pattern)
        assert re.search(pattern, text) and literal and literal in text, pattern
    assert C.required_literal("a|bcd") is None and C.required_literal("<form.*?</form>", "i") is None


def test_whole_list_against_plain_regexes(spark, m):
    """The folded list equals applying the strip filters one after another in Python."""
    rows = m.articles.select("page_id", "content").collect()
    strips = [f for f in DEFAULT_FILTERS if f[0] == "strip"]
    got = {r["page_id"]: r["content"] for r in C.clean(
        m.articles.withColumn("guid", F.lit("g")), strips).select("page_id", "content").collect()}
    flags = {"i": re.I, "m": re.M, "s": re.S}
    for row in rows:
        text = row["content"]
        for _, pattern, names, sub, repeat in strips:
            value = sum(flags[f] for f in names)
            text, n = re.subn(pattern, sub, text, flags=value)
            while repeat and n:
                text, n = re.subn(pattern, sub, text, flags=value)
        assert got[row["page_id"]] == text


def page(spark, head):
    return spark.createDataFrame([("http://a.com/x/y", f"<html><head>{head}</head><body></body></html>")], "url string, html string")


LINK = '<link rel="alternate" type="application/{}+xml" title="{}" href="{}">'


@pytest.mark.parametrize("head,expected", [
    (LINK.format("rss", "R", "r") + LINK.format("atom", "A", "/a") + LINK.format("atom", "C", "/comments"), "http://a.com/a"),
    (LINK.format("atom", "Comments Feed", "/c") + LINK.format("rss", "R", "r"), "http://a.com/x/r"),
    ('<base href="http://b.org/q/">' + LINK.format("rss", "R", "r"), "http://b.org/q/r"),
    ("<LINK REL='alternate' TYPE='application/rss+xml' HREF='z'>", "http://a.com/x/z"),
    ('<link rel="stylesheet" href="s.css">', None),
])
def test_discovery(spark, head, expected):
    assert D.discover_feeds(page(spark, head)).first()["feed_url"] == expected


def test_candidates(spark):
    rows = D.candidate_feeds(page(spark, "")).orderBy("attempt").collect()
    assert len(rows) == 24 and rows[0]["candidate"] == "http://a.com/x/feed" and rows[5]["candidate"] == "http://a.com/feed"
