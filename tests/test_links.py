from __future__ import annotations

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagetide.functions import scoring as S
from pagetide.functions import urls as U
from pagetide.operators import links as K

BASES = ["https://ex.org", "https://ex.org/", "https://ex.org/a/b/c.html?x=1#t", "http://ex.org:81/a/", "https://ex.org/en/25#top"]
HREFS = ["/p", "p", "./p", "../p", "../../p/", "../../../../p", "?q=2", "#s", "", "//other.org/x/", "https://o.org/y?z", "mailto:a@b",
         "a/./b/../c", "/x/../y/.", "javascript:void(0)", "/a?b=/../c", ".."]


def test_resolve_like_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string").select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("u"))
    got = {(r["b"], r["h"]): r["u"] for r in df.collect()}
    assert got == {(b, h): urljoin(b, h) for b, h in rows}


@pytest.mark.parametrize("url, out", [
    ("https://example.com/page?id=123#section", "https://example.com/page"),
    ("https://example.com/", "https://example.com"),
    ("HTTP://Example.com/a/", "http://Example.com/a"),
    ("https://example.com/a//", "https://example.com/a/"),
    ("mailto:x@y.z", ""),
    ("ftp://x.y/z", ""),
])
def test_normalise(evaluate, url, out):
    assert evaluate(U.normalise(F.lit(url))) == out


@pytest.mark.parametrize("url, text, custom, score", [
    ("https://site.org/call_for_papers", "Submit an abstract here", [], 3.0 + 2.0 + 2.0 + 1.0 + 0.5),
    ("https://site.org/team", "Who we are", [], 0.0),
    ("https://site.org/expo-week", "Expo week and its Fringe events", ["expo", "Fringe"], 3.0),
    ("https://site.org/x/2026/cfp", "Call for papers", [], 3.0 + 1.5 + 2.0 + 1.0 + 0.5 + 1.0),
    ("https://example.com/cfp.pdf", "CFP", [], round((3.0 + 2.0) * 0.7, 2)),
    ("https://example.com/cfp/" + "x" * 150, "CFP", [], 2.5),
])
def test_link_score(evaluate, url, text, custom, score):
    words = S.link_words(F.lit(text), F.lit(""), F.lit(""))
    listed = F.array(*[F.lit(c) for c in custom]) if custom else None
    assert evaluate(S.link_score(F.lit(url), F.lit(text), words, listed)) == score


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def seed(spark, html):
    return spark.createDataFrame([(1, "https://example.com", html)], "page_id int, url string, html string")


def test_discover_obeys_the_rules(spark):
    html = """<body><p><a href="/paper-desk">How to submit</a></p><a href="/team">Who we are</a><a href="/donate/papers">Submit a gift</a>
      <a href="https://other.net/call">Submit elsewhere</a><a href="/deadline-list">When</a></body>"""
    out = K.discover(seed(spark, html), "page_id", strings("donate"), F.lit(True), strings("call", "paper", "deadline"), strings("submit", "cfp"))
    assert [r["link"] for r in out.collect()] == ["https://example.com/paper-desk"]


def test_discover_keeps_the_best(spark):
    html = "<body>" + "\n".join(f'<p><a href="/page{i}">CFP {i}</a></p>' for i in range(20)) + "</body>"
    out = K.discover(seed(spark, html), "page_id", strings(), F.lit(False), strings(), strings(), limit=5)
    assert [r["link"] for r in out.orderBy("rank").collect()] == [f"https://example.com/page{i}" for i in range(5)]


def test_first_anchor_of_a_link_counts(spark):
    html = '<a href="/cfp?x">About</a><a href="/cfp/#y">Call for papers</a>'
    out = K.first_per_link(K.resolved(K.page_anchors(seed(spark, html))), "page_id").collect()
    assert [(r["link"], r["text"]) for r in out] == [("https://example.com/cfp", "About")]
