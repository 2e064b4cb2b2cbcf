"""Text cleaning over an html string column.

Everything here is a chain of built-in string functions, so it runs per row
with no shuffle and no Python.  Apart from the split into lexemes, patterns are kept to the syntax that
Java and RE2 share, which lets the same pattern be checked in another SQL engine.
"""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.once import let

# Markers of a page that is filled in by a script.
JS_MARKERS = (
    '<div id="root"',
    '<div id="app"',
    "data-react-root",
    "ng-app",
    "__NEXT_DATA__",
    "nuxt",
    "data-reactroot",
    '<div id="__next"',
)
SMALL_PAGE_CHARS = 5000

# Elements that hold no page content.
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript")
SNIPPET_NOISE_TAGS = ("script", "style", "nav", "footer", "header")

# A class or id containing one of these marks a noise element.
NOISE_ATTR_WORDS = (
    "menu", "navigation", "sidebar", "footer", "header", "cookie", "banner",
    "advertisement", "ad-", "social", "share", "comment", "related", "recommend",
)

RAW_TEXT_TAGS = ("script", "style")

# Whitespace as Unicode sees it; plain \s covers only ASCII in Java and RE2.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
# Looked at before SPACE, whose many ranges are slow to test: no letter or sign of ASCII, and no single blank before one.
MAYBE_SPACE = "(?=[^!-~])(?! [!-~])"
TAG = r"<[a-zA-Z/!?][^>]*>"
# Stands for removed markup between two texts: a character for private use.
BREAK = "\ue000"
TAG_OR_BREAK = f"{TAG}|{BREAK}"
# Stands for the end of a line that a reader sees: another one.
LINE = "\ue001"
# End tags that end a line, start tags that may end one before them, and the line break.
LINE_END = (
    r"(?i)(</(?:address|article|aside|blockquote|caption|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|li|main|nav|ol|p|pre|section"
    r"|table|td|th|tr|ul)\s*>|<(?:dd|div|dt|h[1-6]|li|p|tr)(?:\s[^>]*)?>|<br\s*/?>)"
)

# Stand for ">" and "<" inside a quoted attribute value, so that a tag ends at the first ">".
MASKED = "\ue002\ue003"

# Comments and the bodies of script and style hold no markup.  One alternation,
# matched left to right, so that a comment inside a script stays script text.
OPAQUE = (
    r"(?is)<script(?:\s[^>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:\s[^>]*)?>.*?(?:</style\s*>|\z)"
    r"|<!--.*?(?:-->|\z)"
)


def element_pattern(tags: tuple[str, ...]) -> str:
    """Pattern of a whole closed element with one of the given names."""
    return "(?is)" + "|".join(rf"<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in tags)


def balanced(html: Column, tags: tuple[str, ...]) -> Column:
    """No element of the given names is unclosed or nested in one of its name.

    `html` is free of comments, scripts and styles.  Only then does a pattern
    find the same elements as the tree does.
    """
    rest = [t for t in tags if t not in RAW_TEXT_TAGS]
    opened = F.regexp_count(html, F.lit(rf"(?i)<(?:{'|'.join(rest)})(?:\s[^>]*)?>"))
    whole = reduce(lambda a, b: a + b, [F.regexp_count(html, F.lit(element_pattern((t,)))) for t in rest])
    return opened == whole


# The inside of a tag: a quoted value may hold ">".  Possessive, so that a long tag is read in one loop.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
LEXEME = (
    rf"(?is)<script(?:\s{ATTRIBUTES})?>.*?(?:</script\s*>|\z)|<style(?:\s{ATTRIBUTES})?>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
    rf"|<[a-z]{ATTRIBUTES}>|[^<]++|<"
)
# A tag whose quoted value holds a bracket; only pages with one are split into lexemes.
QUOTED_BRACKET = r"""(?i)<[a-z][^<>]*=\s*(?:"[^"<>]*[<>]|'[^'<>]*[<>])"""


def drop_opaque(html: Column) -> Column:
    """Html with each comment, script and style turned into a BREAK, and brackets in quoted values masked."""

    def one(part: Column) -> Column:
        opaque = part.rlike(r"(?i)^<(?:!--|(?:script|style)[\s>])")
        masked = F.concat(F.lit("<"), F.translate(F.substring(part, 2, 2**31 - 1), "><", MASKED))
        tag = F.concat(F.left(masked, F.length(part) - 1), F.lit(">"))
        return F.when(~part.rlike("^<[a-zA-Z!]"), part).when(opaque, F.lit(BREAK)).when(part.rlike("(?s)^<[a-zA-Z].*[<>].*>$"), tag).otherwise(part)

    def split(h: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(h, F.lit(LEXEME), F.lit(0)), one), "")

    return let(html, lambda h: F.when(h.rlike(QUOTED_BRACKET), split(h)).otherwise(F.regexp_replace(h, OPAQUE, BREAK)))


def unmasked(text: Column) -> Column:
    """Text out of a tag, its brackets as they were."""
    return F.translate(text, MASKED, "><")


def drop_elements(html: Column, tags: tuple[str, ...]) -> Column:
    """Html without comments, scripts, styles and the given elements."""
    return drop_closed(drop_opaque(html), tags)


def drop_closed(html: Column, tags: tuple[str, ...]) -> Column:
    rest = tuple(t for t in tags if t not in RAW_TEXT_TAGS)
    return F.regexp_replace(html, element_pattern(rest), BREAK)


def _table(pairs: dict[str, str]) -> Column:
    """A constant map; one text, so that the plan stays small, folded into a map once."""
    return F.str_to_map(F.lit("\ue000".join(f"{k}\ue001{v}" for k, v in pairs.items())), F.lit("\ue000"), F.lit("\ue001"))


# The standard's table, from Python's library: names that need a semicolon, and the old ones that do without.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
LEGACY = tuple(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name)))
COMMON = ("amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "reg", "trade", "middot", "bull", "hellip", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "euro")
# What numbers 128 to 159 stand for: the bytes of windows-1252, or themselves where that has none.
HIGH = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))
REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]+;?|[^&]+|&"


def _numeric(part: Column) -> Column:
    """The character of a decimal or hexadecimal reference, by the standard's rules."""
    hexadecimal = part.rlike("^&#[xX]")
    digits = F.regexp_extract(part, "^&#[xX]?0*+([0-9a-fA-F]*)", 1)
    far = F.length(digits) > F.when(hexadecimal, 6).otherwise(7)
    number = F.when(digits == "", 0).when(far, 0x110000).when(hexadecimal, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))

    def char(n: Column) -> Column:
        nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        replaced = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(replaced, "\ufffd").when(n.between(128, 159), F.substring(F.lit(HIGH), (n - 127).cast("int"), F.lit(1))).when(nothing, "").otherwise(plain)

    return let(number, char)


def _named(part: Column) -> Column:
    """A name with its semicolon, or else the longest old name it begins with; other text stays."""
    name = F.regexp_extract(part, "^&([a-zA-Z0-9]+);$", 1)
    known = F.coalesce(F.try_element_at(_table({n: NAMED[n] for n in COMMON}), name), F.try_element_at(_table(NAMED), name))
    prefix = F.regexp_extract(part, f"^&({'|'.join(LEGACY)})", 1)
    old = F.concat(F.try_element_at(_table({n: html5[n] for n in LEGACY}), prefix), F.substr(part, F.length(prefix) + 2))
    return F.coalesce(F.when(name != "", known), F.when(prefix != "", old), part)


def decode_entities(text: Column) -> Column:
    """Text with its character references decoded as the html standard says; text without "&" is left alone."""

    def one(part: Column) -> Column:
        return F.when(part.startswith("&#") & (F.length(part) > 2), _numeric(part)).when(part.startswith("&") & (F.length(part) > 1), _named(part)).otherwise(part)

    def decoded(t: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), one), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{MAYBE_SPACE}{SPACE}++", " "))


def markup_to_text(html: Column) -> Column:
    """Text nodes joined by one space, tags gone."""
    return collapse_space(_without_markup(html))


def markup_to_one_line(html: Column) -> Column:
    """`one_line` of `markup_to_text`, its space squeezed once."""
    return one_line(_without_markup(html))


def _without_markup(html: Column) -> Column:
    return decode_entities(F.regexp_replace(html, TAG_OR_BREAK, " "))


def markup_to_lines(html: Column) -> Column:
    """Text nodes, each trimmed, joined by one space; space inside them stays.

    Tags become breaks first, so that space next to a tag can be told from
    space inside a text.
    """
    marked = decode_entities(F.regexp_replace(html, TAG, BREAK))
    before = F.regexp_replace(marked, rf"{MAYBE_SPACE}(?<!{SPACE}){SPACE}++{BREAK}", BREAK)
    return collapse_ends(F.regexp_replace(before, rf"{BREAK}(?:{SPACE}|{BREAK})*+", " "))


def mark_lines(html: Column) -> Column:
    """Html with a LINE before each tag that ends a line."""
    return F.regexp_replace(html, LINE_END, LINE + "$1")


def one_line(text: Column) -> Column:
    """Text without its LINE marks, its space squeezed."""
    return collapse_space(F.replace(text, F.lit(LINE), F.lit(" ")))


def lines(text: Column) -> Column:
    """Collapsed text with each run of LINE marks as one line break."""
    return collapse_ends(F.regexp_replace(text, f"[ {LINE}]*{LINE}[ {LINE}]*", "\n"))


def clean_text(html: Column, tags: tuple[str, ...] = NOISE_TAGS) -> Column:
    """Visible text with the given elements removed, where none is nested in its like."""
    return markup_to_text(drop_elements(html, tags))


def strip_markup(html: Column) -> Column:
    """Plain-text form of a mail body: tags vanish without leaving a space."""
    bare = html
    for tag in ("style", "script"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", "")
    return collapse_space(bare)


def needs_js(html: Column) -> Column:
    lowered = F.lower(html)
    marked = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m.lower())) for m in JS_MARKERS])
    return marked | (F.length(html) < SMALL_PAGE_CHARS)


def noise_attr_pattern() -> str:
    """Matches an opening tag whose class or id contains a noise word."""
    words = "|".join(NOISE_ATTR_WORDS)
    return rf"""(?is)<[a-z][^>]*\s(?:class|id)\s*=\s*(?:"[^">]*(?:{words})[^">]*"|'[^'>]*(?:{words})[^'>]*'|[^\s"'>]*(?:{words})[^\s"'>]*)"""


def sentences(text: Column, pattern: str = r"[.!?]\s+", min_chars: int = 10) -> Column:
    """Trimmed sentences of at least `min_chars`, in text order."""
    parts = F.transform(F.split(text, pattern), collapse_ends)
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def collapse_ends(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def with_snippets(rows: DataFrame, sents: Column, keywords: Column, out: str = "snippets", limit: int = 50) -> DataFrame:
    """Adds the first `limit` sentences holding a keyword, repeats dropped ignoring case.

    `keywords` are in lower case.  The first spelling of a repeated sentence is
    kept: `array_distinct` keeps first occurrences in order, and only the kept
    ones are looked up again.  Done in steps, each used twice by the next, so
    that no step is folded into a lambda and evaluated once per element.
    """
    both = F.transform(sents, lambda s: F.struct(s.alias("as_is"), F.lower(s).alias("low")))
    hits = F.filter("_both", lambda p: F.exists(keywords, lambda k: F.contains(p["low"], k)))
    steps = (
        rows.withColumn("_both", both)
        .withColumn("_hits", F.when(F.size("_both") > 0, hits).otherwise(F.col("_both")))
        .withColumn("_low", F.transform("_hits", lambda p: p["low"]))
    )
    found = F.transform(
        F.slice(F.array_distinct("_low"), 1, limit),
        lambda low: F.get(F.col("_hits"), F.array_position(F.col("_low"), low).cast("int") - 1)["as_is"],
    )
    return steps.withColumn(out, found).drop("_both", "_hits", "_low")


def truncate(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)
