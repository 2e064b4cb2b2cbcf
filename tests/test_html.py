"""Text cleaning and element structure, against a small tree walk."""

from __future__ import annotations

import html as library
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators import links as K
from pagetide.operators import text as T

VOID = set(T.VOID_TAGS)
# Tags before whose end, or before which, a reader sees a line end.
ENDS = {"address", "article", "aside", "blockquote", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
        "header", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
STARTS = {"dd", "div", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "tr", "br"}


class Walk(HTMLParser):
    """Text nodes with their open elements, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.anchors, self.elements, self.lined = [], [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in STARTS:
            self.lined.append((H.LINE, list(self.stack)))
        if tag in VOID:
            return
        element = {"tag": tag, "attrs": dict(attrs), "text": []}
        if tag == "a" and "href" in element["attrs"]:
            box = next((e for e in reversed(self.stack) if e["tag"] in T.CONTEXT_TAGS), None)
            self.anchors.append((element, box))
        self.stack.append(element)
        self.elements.append(list(self.stack))

    def handle_endtag(self, tag):
        if tag in ENDS:
            self.lined.append((H.LINE, list(self.stack)))
        if self.stack and self.stack[-1]["tag"] == tag:
            self.stack.pop()

    def handle_data(self, data):
        if any(e["tag"] in ("script", "style") for e in self.stack):
            return
        for e in self.stack:
            e["text"].append(data.strip())
        self.nodes.append((data, list(self.stack)))
        self.lined.append((data, list(self.stack)))


def is_noise(element, attributes=True):
    if element["tag"] in H.NOISE_TAGS:
        return True
    values = (element["attrs"].get("class") or "") + "\n" + (element["attrs"].get("id") or "")
    return attributes and any(w in values.lower() for w in H.NOISE_ATTR_WORDS)


def walk(html):
    parser = Walk()
    parser.feed(html)
    parser.close()
    return parser


def squeeze(parts):
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def expected_filtered(html):
    return squeeze(d for d, path in walk(html).nodes if not any(is_noise(e) for e in path))


def expected_main(html, lined=False):
    tree = walk(html)
    nodes = [(d, path) for d, path in (tree.lined if lined else tree.nodes) if not any(is_noise(e, False) for e in path)]
    shown = [path[-1] for path in tree.elements if not any(is_noise(e, False) for e in path)]
    for tag in T.MAIN_TAGS:
        first = next((e for e in shown if e["tag"] == tag), None)
        if first is not None:
            return squeeze(d for d, path in nodes if any(e is first for e in path))
    return squeeze(d for d, _ in nodes)


def expected_lines(html):
    """The main text with a line break where line ends stand between its words."""
    return re.sub(f"[ {H.LINE}]*{H.LINE}[ {H.LINE}]*", "\n", expected_main(html, True)).strip()


def random_page(seed):
    rng = random.Random(seed)
    words = ["call", "for papers", "due &amp; open", "10 &lt; 20", "&copy; 2024", "two\n lines ", "Straße", "a&nbsp;b", "x&#228;y", "news.", "&uuml;ber &#x2019;x &#128640;", "&notit; &ampx", "3 &gt 2 & 1"]
    tags = ["div", "p", "section", "article", "nav", "main", "ul", "li", "aside", "footer", "span", "a", "table", "td"]
    classes = ["", ' class="menu"', ' class="ad"', " class='top ad-slot x'", ' id="Social-Box"', ' data-x="menu"', ' class="lead"', " id=sidebar",
               ' title="a > b"', " data-y='<nav> x'", ' data-z = "</p>" class="lead"', " alt=\"it's > 1\"", " data-q=a'b"]

    def element(depth):
        tag = rng.choice(tags)
        title = rng.choice(["", ' title="x > y"', " title='<b>'"])
        attrs = f'{title} href="/{rng.randrange(9)}"' if tag == "a" else rng.choice(classes)
        inner = "".join(piece(depth + 1) for _ in range(rng.randrange(4)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def piece(depth):
        kind = rng.random()
        if kind < 0.45 or depth > 5:
            return f" {rng.choice(words)} "
        if kind < 0.47:
            return '<script data-x="a > b">if (a < b) { x = "<p class=menu>"; }</script>'
        if kind < 0.5:
            return '<script>var t = "</p><nav>"; // <!-- x</script>'
        if kind < 0.55:
            return "<!-- <nav> hidden </div> -->"
        if kind < 0.6:
            return "<br>"
        return element(depth)

    return "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(piece(0) for _ in range(6)) + "</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://s.example.org/{i}", random_page(i)) for i in range(150)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").cache(), {r[0]: r[2] for r in rows}


def test_filtered_text_follows_the_tree(pages):
    df, html = pages
    got = {r[0]: r[1] for r in T.filtered_text(df).collect()}
    assert got == {k: expected_filtered(h) for k, h in html.items()}


def test_structural_filtered_text_follows_the_tree(pages):
    df, html = pages
    got = {r[0]: r[1] for r in T.structural_text(df, "page_id", H.NOISE_TAGS, True, "t").collect()}
    assert got == {k: expected_filtered(h) for k, h in html.items()}


def test_snippet_text_follows_the_tree(pages):
    df, html = pages

    def expected(page):
        kept = (d.strip() for d, path in walk(page).nodes if not any(e["tag"] in H.SNIPPET_NOISE_TAGS for e in path))
        return " ".join(d for d in kept if d)

    want = {k: expected(h) for k, h in html.items()}
    assert {r[0]: r[1] for r in T.snippet_text(df).collect()} == want
    assert {r[0]: r[1] for r in T.structural_text(df, "page_id", H.SNIPPET_NOISE_TAGS, False, "t", True).collect()} == want


def test_main_text_follows_the_tree(pages):
    df, html = pages
    want = {k: expected_main(h) for k, h in html.items()}
    assert {r[0]: r[1] for r in T.structural_main_text(df).collect()} == want
    assert {r[0]: r[1] for r in T.main_text(df).collect()} == want


def test_page_texts_agree_with_the_single_operators(spark, pages):
    df, html = pages
    rows = {r["page_id"]: r for r in T.page_texts(df, F.array(F.lit("call"), F.lit("due"))).collect()}
    assert {k: r["filtered_text"] for k, r in rows.items()} == {k: expected_filtered(h) for k, h in html.items()}
    assert {k: r["main_text"] for k, r in rows.items()} == {k: expected_lines(h) for k, h in html.items()}
    alone = {r[0]: r[1] for r in T.page_snippets(df, F.array(F.lit("call"), F.lit("due"))).collect()}
    assert {k: r["snippets"] for k, r in rows.items()} == alone


def test_link_context_is_the_nearest_box(pages):
    df, html = pages
    want = {}
    for k, h in html.items():
        for n, (_, box) in enumerate(walk(h).anchors, 1):
            text = "".join(box["text"]) if box else ""
            want[k, n] = text[:200] + "..." if len(text) > 200 else text
    got = {(r["page_id"], r["pos"]): r["context"] for r in T.anchor_contexts(df).collect()}
    assert got == want


def test_anchors_in_page_order(pages):
    df, html = pages
    want = {(k, n): (e["attrs"]["href"], "".join(e["text"])) for k, h in html.items() for n, (e, _) in enumerate(walk(h).anchors, 1)}
    nested = {k for k, h in html.items() if re.search(r"<a [^>]*>(?:(?!</a>).)*<a ", h, re.S)}
    got = {(r["page_id"], r["pos"]): (r["href"], r["text"]) for r in K.page_anchors(df).collect()}
    assert set(got) == set(want)
    assert {k: v for k, v in got.items() if k[0] not in nested} == {k: v for k, v in want.items() if k[0] not in nested}


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("<p>a</p><p>b</p>", "a b"),
    ("a < b and c > d", "a < b and c > d"),
    ("x &amp;lt; y", "x &lt; y"),
    ("<script>never closed <p>x", ""),
    ("<p>kept</p><style>p{}</style><noscript>gone</noscript>", "kept"),
    ("<header>h</header><head>t</head>", "t"),
    ("a &nbsp;   b", "a b"),
])
def test_clean_text(evaluate, html, text):
    assert evaluate(H.clean_text(F.lit(html))) == text


def reference(rng):
    numbers = [0, 1, 9, 10, 11, 13, 31, 65, 127, 128, 130, 150, 159, 160, 300, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F680, 0x10FFFF, 0x110000, 10**12]
    number = rng.choice([*numbers, rng.randrange(0x110000)])
    name = rng.choice(list(H.html5))
    return rng.choice([
        f"&{name}", f"&{name.rstrip(';')}{rng.choice(['', 'x', ';', '=1;', ' '])}", f"&#{number}{rng.choice(['', ';', ' '])}",
        f"&#{rng.choice('xX')}{number:x}{rng.choice(['', ';', 'z'])}", rng.choice(["a", "&", " ", "&#", "&#x;", ";", "&#;", "&a;", "&&amp;", "&notin;", "&ampamp;", "&#000000000065;"]),
    ])


def test_references_as_the_library_reads_them(spark):
    rng = random.Random(3)
    rows = [(i, "".join(reference(rng) for _ in range(rng.randrange(9)))) for i in range(3000)]
    got = spark.createDataFrame(rows, "i int, t string").select("t", H.decode_entities(F.col("t")).alias("d")).collect()
    assert [r for r in got if r["d"] != library.unescape(r["t"])] == []


def test_quoted_brackets(spark):
    page = '<p>one</p><a title="a > b" href="/x?a=1&amp;b=2">go</a><img alt="<nav>"> two <a href=\'/y\' title=\'2 < 3\'>on</a><script x=">">"</p>"</script><p class="b > menu">gone</p>'
    df = spark.createDataFrame([(1, "https://s.example.org/", page)], "page_id int, url string, html string")
    assert T.filtered_text(df).first()["filtered_text"] == "one go two on"
    assert [(r["href"], r["text"], r["title"]) for r in K.page_anchors(df).orderBy("pos").collect()] == [("/x?a=1&b=2", "go", "a > b"), ("/y", "on", "2 < 3")]
    assert {r["open_tag"] for r in T.element_intervals(df).collect()} >= {'<a title="a > b" href="/x?a=1&amp;b=2">', '<p class="b > menu">'}


def test_space_is_squeezed_as_by_the_plain_pattern(spark):
    """Every kind of space beside letters of ASCII and others, alone and in runs; space in front of breaks."""
    rng = random.Random(5)
    signs = [*H.SPACE_CHARS, " ", " ", " ", "a", "~", "!", "\x7f", "é", "\u200b", H.LINE, "<b>"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(400)]
    plain = [re.sub(H.SPACE.replace("{", "").replace("}", "").replace("\\x1680", "\\u1680").replace("\\x20", "\\u20").replace("\\x30", "\\u30") + "+", " ", t).strip(" ") for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    text = F.regexp_replace("t", H.TAG_OR_BREAK, " ")
    got = rows.select("i", H.collapse_space(F.col("t")).alias("c"), H.markup_to_one_line(F.col("t")).alias("o"), H.one_line(H.collapse_space(text)).alias("w")).orderBy("i").collect()
    assert [r["c"] for r in got] == plain
    assert [r["o"] for r in got] == [r["w"] for r in got]


def test_class_ad_alone_is_no_noise(evaluate):
    assert not evaluate(F.lit('<div class="ad">').rlike(H.noise_attr_pattern()))
    assert evaluate(F.lit('<div class="x ad-top">').rlike(H.noise_attr_pattern()))


def test_strip_markup(evaluate):
    assert evaluate(H.strip_markup(F.lit("<style>x</style><p>Hello <b>world</b>!</p>"))) == "Hello world!"


@pytest.mark.parametrize("html, needs", [("x" * 5000, False), ("x" * 4999, True), ("y" * 6000 + '<DIV ID="root"', True)])
def test_needs_js(evaluate, html, needs):
    assert evaluate(H.needs_js(F.lit(html))) is needs


def test_snippets_keep_first_spelling_and_limit(spark):
    text = "Deadline is near now. DEADLINE IS NEAR NOW. short. Another deadline here! No match in this one. " + " ".join(
        f"Deadline number {i} is here." for i in range(80))
    df = spark.createDataFrame([(1, f"<p>{text}</p><nav>Deadline in the menu bar.</nav>")], "page_id int, html string")
    got = T.page_snippets(df, F.array(F.lit("deadline"))).first()["snippets"]
    assert got[:3] == ["Deadline is near now", "Another deadline here", "Deadline number 0 is here"]
    assert len(got) == 50


def test_whole_long_page_is_processed(spark):
    body = "<p>word number one. </p>" * 60000 + "<p>The last deadline sentence</p>"
    df = spark.createDataFrame([(1, f"<main>{body}</main>")], "page_id int, html string")
    assert T.main_text(df).first()["main_text"].endswith("The last deadline sentence")
    assert T.structural_main_text(df).first()["main_text"].endswith("The last deadline sentence")
    assert T.page_snippets(df, F.array(F.lit("last deadline"))).first()["snippets"] == ["The last deadline sentence"]
