"""Main text of pages: parser events to lines, text-to-tag ratios, smoothing, clusters.

The standard library's parser sends the events of a page.  A block tag ends a
line (missing end tags of a head, a link or a button are understood), so a line is what a reader sees as one block, with the number of tags in
it.  Lines inside page furniture (menus, headers, footers, forms, scripts,
adverts, notices, comments) are never content.  The other lines form regions by
their nearest sectioning element; text-to-tag ratios are smoothed by a Gaussian
and a threshold from their spread clusters the lines, and the regions that hold
the clusters are the content, whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from pagetide.llm.shared import batches

# Element names of the HTML standard, and words that name page furniture.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("head title script style noscript template iframe object svg math canvas audio video map".split())
FURNITURE = frozenset("nav header footer aside form menu dialog search button select textarea input fieldset label option".split())
SECTIONS = frozenset("article main section div body td".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form alert".split())
NOISE = re.compile(
    r"(^|[^a-z])(ad|ads|advert|adverts|advertisement|advertising|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|"
    r"disclaimer|discussion|disqus|dropdown|footer|gdpr|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|overlay|"
    r"pager|pagination|popup|popular|promo|promoted|promotion|recommended|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor|"
    r"sponsored|subscribe|subscription|tags|teaser|toc|toolbar|widget)([^a-z]|$)", re.I)
TOP = re.compile(r"(^|[^a-z])(banner|header|masthead)([^a-z]|$)", re.I)
CORE = frozenset("html body main article".split())
#: Elements whose end tag may be missing: a new one of the same kind, or an end of an outer one, closes them.
LOOSE = frozenset("p li dt dd td th tr option".split())
#: What a head may hold; anything else ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that end a button left open.
ENDS_BUTTON = frozenset("article button h1 h2 h3 h4 h5 h6 main ol p section table ul".split())
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags, characters inside links, region, and whether it is furniture."""

    def __init__(self, spared: frozenset[int] = frozenset(), core: bool = False) -> None:
        """`spared`: numbers of marked wrappers that are no furniture; `core`: marked wrappers do not reach into an article or main."""
        super().__init__(convert_charrefs=True)
        self.spared, self.core = spared, core
        self.lines: list[tuple[str, int, int, int]] = []
        # name, unread, furniture, region, sure, marked and wrapper before it, link
        self.stack: list[tuple[str, bool, bool, int, bool, int, int, bool]] = []
        self.region = self.regions = 0
        self.unread = self.furniture = self.links = self.marked = 0
        # elements that are furniture by class, id or form only: the innermost, those around each, characters outside links
        self.wrapper = 0
        self.around: list[int] = [0]
        self.held: list[int] = [0]
        self.cores: list[int] = []  # wrapper around each open article or main
        self.core_held = self.core_free = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.breaks = 0  # block tags so far
        self.opened = 0  # block tags before the open link
        self.doubtful: list[tuple[int, int, int, int]] = []  # text behind a block tag in an open link: line, length, wrapper, core
        self.kind: dict[int, str] = {0: ""}
        self.above: dict[int, int] = {0: 0}

    def end_line(self) -> None:
        self.breaks += 1
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.linked, self.region))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self._implied_ends(tag)
        self.tags += 1
        if tag in VOID:
            return
        if tag in LOOSE and self.stack and self.stack[-1][0] == tag:
            self._pop()
        # a header inside an article holds its title
        sure = tag in FURNITURE and tag != "form" and not (tag == "header" and self._inside())
        marked = tag == "form"
        if attrs:
            given = {k: v or "" for k, v in attrs}
            sure = sure or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            marked = marked or tag not in CORE and bool(self._noise(f"{given.get('class', '')} {given.get('id', '')}"))
        marked = marked and not sure
        unread = tag in UNREAD
        link = tag == "a" and any(k == "href" for k, _ in attrs)
        self.stack.append((tag, unread, sure or marked, self.region, sure, self.marked, self.wrapper, link))
        self.unread += unread
        self.furniture += sure
        if link:
            self.links += 1
            self.opened, self.doubtful = self.breaks, []
        if marked:
            self.around.append(self.wrapper)
            self.held.append(0)
            self.wrapper = len(self.held) - 1
            self.marked += self.wrapper not in self.spared
        if tag in ("article", "main"):
            if self.core and not self.cores:
                self.marked = 0
            self.cores.append(self.wrapper)
        if tag in SECTIONS:
            self.regions += 1
            self.kind[self.regions], self.above[self.regions] = tag, self.region
            self.region = self.regions

    def _implied_ends(self, tag: str) -> None:
        """What this start tag ends although its end tag is missing: a head, the link before, a button."""
        names = [x[0] for x in self.stack[-64:]]
        if names and names[-1] == "head" and tag not in HEAD:
            self._pop()
        if tag == "a" and "a" in names:
            depth = len(self.stack) - 1 - names[::-1].index("a")
            if depth == len(self.stack) - 1:
                self._pop()
            elif not self.stack[depth][2]:
                self._unlink(self.stack.pop(depth)[7])
        if tag in ENDS_BUTTON and "button" in names:
            depth = len(self.stack) - 1 - names[::-1].index("button")
            while len(self.stack) > depth:
                self._pop()

    def _unlink(self, link: bool, whole: bool = False) -> None:
        """End of a link; unless its own end tag was there (`whole`), what stood behind block tags in it was no link text."""
        if not link:
            return
        self.links -= 1
        if not whole and not self.links:
            for line, size, wrapper, core in self.doubtful:
                if line == len(self.lines):
                    self.linked -= size
                else:
                    text, tags, linked, region = self.lines[line]
                    self.lines[line] = text, tags, linked - size, region
                self._hold(size, wrapper, core)
        self.doubtful = []

    def _hold(self, size: int, wrapper: int, core: int) -> None:
        """Text outside links: in its wrapper, and in an article or main (`core` 1: inside its own wrapper, 2: inside one around it)."""
        self.held[wrapper] += size
        if core == 1:
            self.core_free += size
        elif core == 2:
            self.core_held += size

    def _core(self) -> int:
        if not self.cores or self.cores[0] != self.wrapper:
            return 0
        return 2 if self.wrapper else 1

    def finish(self) -> None:
        """End of the page: every element ends."""
        while self.stack:
            self._pop()
        self.end_line()

    def _inside(self) -> bool:
        return any(x[0] in ("article", "main") for x in self.stack)

    def _noise(self, words: str) -> bool:
        return len(words) > 1 and bool(NOISE.search(words) or TOP.search(words) and not self._inside())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Any but CDATA is a comment up to the next ">", as in browsers; the library's parser would raise an error."""
        if self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def updatepos(self, i: int, j: int) -> int:
        """Positions in the source are not needed."""
        return j

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if self.stack and self.stack[-1][0] == tag:
            self._pop(whole=True)
            return
        depth = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if depth is None:
            return
        # a stray end tag does not reach out of the section or furniture it stands in
        if any(x[0] in SECTIONS or x[2] for x in self.stack[depth + 1:]) and tag not in SECTIONS and not self.stack[depth][2]:
            return
        while len(self.stack) > depth:
            self._pop(whole=len(self.stack) == depth + 1)

    def _pop(self, whole: bool = False) -> None:
        tag, unread, _, region, sure, self.marked, self.wrapper, link = self.stack.pop()
        self.unread -= unread
        self.furniture -= sure
        self._unlink(link, whole)
        if tag in ("article", "main"):
            self.cores.pop()
        if tag in SECTIONS:
            self.region = region

    def handle_data(self, data: str) -> None:
        size = len(data.strip())
        if size and self.stack and self.stack[-1][0] == "head":
            self._pop()
        if self.unread or self.furniture:
            return
        if not self.links:
            self._hold(size, self.wrapper, self._core())
        if self.marked:
            return
        self.parts.append(data)
        if self.links:
            self.linked += size
            if size and self.breaks > self.opened:
                self.doubtful.append((len(self.lines), size, self.wrapper, self._core()))


def page_lines(html: str) -> Lines:
    """A page read to its end.

    An element that is furniture by its class, its id or as a form only is none
    if nine tenths of the text stand in it, and does not reach into article or
    main elements if all of them stand in such elements and hold more text than
    stands outside.  Without a line left, none of them is furniture.
    """

    def read(spared: frozenset[int] = frozenset(), core: bool = False) -> Lines:
        parser = Lines(spared, core)
        parser.feed(html)
        parser.close()
        parser.finish()
        return parser

    parser = read()
    if len(parser.held) == 1:
        return parser
    held = list(parser.held)
    for k in range(len(held) - 1, 0, -1):
        held[parser.around[k]] += held[k]
    spared = frozenset(k for k in range(1, len(held)) if held[k] and 10 * held[k] >= 9 * held[0])
    core = not parser.core_free and parser.core_held > parser.held[0]
    if spared or core:
        parser = read(spared, core)
    return parser if parser.lines else read(frozenset(range(1, len(held))))


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing with the weights cut at three sigma and made to sum to one at the edges."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), weights, strict=True):
            if 0 <= k < len(values):
                total += w * values[k]
                norm += w
        out.append(total / norm)
    return out


def main_text(html: str, sigma: float = 1.0) -> str:
    """Main text of a page; empty for a page without any.

    The ratio of a line is its characters outside links per tag.  Lines at or
    above the threshold (half the standard deviation of the smoothed ratios,
    at most their mean) are clustered as content.  All article and main elements
    are the content if they hold half of it, else the innermost region that
    holds all of it; regions are taken whole, with all inside them, so that short
    paragraphs stay.  Outside article and main elements, regions of links without
    any such line and runs of lines that are nothing but links are left out.
    """
    parser = page_lines(html)
    lines = parser.lines
    if not lines:
        return ""

    weight: dict[int, int] = {}
    above, kind = parser.above, parser.kind
    ratios = smoothed([(len(text) - min(linked, len(text))) / max(tags, 1) for text, tags, linked, _ in lines], sigma)
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    least = min(spread / 2, mean)
    own: dict[int, int] = {}
    for (text, _, _, region), ratio in zip(lines, ratios, strict=True):
        if ratio >= least:
            own[region] = own.get(region, 0) + len(text)
    for region, size in own.items():
        while True:
            weight[region] = weight.get(region, 0) + size
            if not region:
                break
            region = above[region]

    def within(chosen: set[int]) -> set[int]:
        """The chosen regions and all inside them; a region is numbered after the one around it."""
        found = set(chosen)
        for region in range(1, parser.regions + 1):
            if above[region] in found:
                found.add(region)
        return found

    marked = {r for r in kind if kind[r] in ("article", "main")}
    inner = within(marked)
    if 2 * sum(weight.get(r, 0) for r in marked if above[r] not in inner) >= weight[0]:
        chosen = inner
    else:
        best = max(r for r in weight if weight[r] == weight[0])  # regions that hold all are inside each other
        chosen = within({best})
        size, links = [0] * (parser.regions + 1), [0] * (parser.regions + 1)
        for text, _, linked, region in lines:
            size[region] += len(text)
            links[region] += linked
        for region in range(parser.regions, 0, -1):
            size[above[region]] += size[region]
            links[above[region]] += links[region]
        dense = within({r for r in chosen - inner if r not in weight and 2 * links[r] >= size[r] > 0})
        chosen -= dense - inner
    only = [region not in inner and _menu(text, linked) for text, _, linked, region in lines]
    runs = [x and (a or b) for a, x, b in zip([False, *only], only, [*only[1:], False])]
    return " ".join(text for (text, _, _, region), menu in zip(lines, runs, strict=True) if region in chosen and not menu)


def _menu(text: str, linked: int) -> bool:
    """A line that is nothing but links."""
    return linked > 0 and linked * 10 >= len(text) * 9


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds `main_text` (string, never null) to every page, read from its whole html.

    Null and empty html give an empty text.  One row per input row, all columns
    of `pages` but the html kept; one named main_text is replaced.
    """
    pages = pages.drop("main_text")
    kept = [c for c in pages.columns if c != html_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, html_col):
            texts = [main_text(x.as_py() or "") for x in batch.column(html_col)]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "main_text"])

    fields = pages.select(*(f"`{c}`" for c in kept)).schema.add("main_text", "string")
    return pages.mapInArrow(run, fields)
