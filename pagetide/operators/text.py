"""Page text that depends on element structure.

A page is split into tags and text nodes, one row each.  The html is
repartitioned by page once, before the split; every window below is
partitioned by the page (or by more), so no further shuffle is needed, and a
table bucketed by page needs none at all.  A group is never more than one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions.once import once

TOKEN = rf"{H.TAG}|[^<{H.BREAK}]+|<"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9-]*)"
# Elements that never have an end tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "source", "track", "wbr")
MAIN_TAGS = ("main", "article", "body")
CONTEXT_TAGS = ("p", "div", "li", "td", "article")
CONTEXT_CHARS = 200


def page_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, token, tag, closing): tags and text nodes in page order.

    `tag` is NULL for text nodes and for tags that cannot enclose anything.
    A page without any token keeps one row with a NULL token.
    """
    parts = F.regexp_extract_all(H.drop_opaque(F.col(html)), F.lit(TOKEN), F.lit(0))
    rows = pages.select(key, html).repartition(F.col(key)).select(key, F.posexplode_outer(parts).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", TAG_NAME, 1))
    enclosing = (name != "") & ~name.isin(*VOID_TAGS) & ~F.col("token").endswith("/>")
    return rows.withColumn("tag", F.when(enclosing, name)).withColumn("closing", F.col("token").startswith("</"))


def with_element_end(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds `end_pos`, the position of the end tag, to closed opening tags.

    Depth counts open elements of the same name, so an element and its own end
    tag are neighbours among the tags of one name and depth.
    """
    by_tag = Window.partitionBy(key, "tag").orderBy("pos")
    step = F.when(F.col("closing"), -1).otherwise(1)
    running = F.sum(step).over(by_tag.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    leveled = tokens.withColumn("depth", running + F.when(F.col("closing"), 1).otherwise(0))
    by_depth = Window.partitionBy(key, "tag", "depth").orderBy("pos")
    follower = F.lead(F.struct("pos", "closing")).over(by_depth)
    ends = F.col("tag").isNotNull() & ~F.col("closing") & F.col("_next.closing")
    return (
        leveled.withColumn("_next", follower)
        .withColumn("end_pos", F.when(ends, F.col("_next.pos")))
        .drop("_next")
    )


def element_intervals(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per closed element: key, tag, start_pos, end_pos, open_tag."""
    marked = with_element_end(page_tokens(pages, key), key)
    return marked.filter("end_pos IS NOT NULL").select(
        key, "tag", F.col("pos").alias("start_pos"), "end_pos", H.unmasked(F.col("token")).alias("open_tag")
    )


def noise_element(with_attributes: bool, tags: tuple[str, ...] = H.NOISE_TAGS) -> Column:
    by_name = F.col("tag").isin(*tags)
    if not with_attributes:
        return by_name
    return by_name | F.col("token").rlike(H.noise_attr_pattern())


def covered(noise: Column, key: str) -> Column:
    """The token lies in a closed noise element.

    The furthest end of any noise element opened so far tells it, so this is
    one running maximum and not an interval join.
    """
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(noise & F.col("end_pos").isNotNull(), F.col("end_pos"))).over(so_far)
    return F.coalesce(reach >= F.col("pos"), F.lit(False))


def without_noise(marked: DataFrame, noise: Column, key: str = "page_id") -> DataFrame:
    return marked.withColumn("covered", covered(noise, key))


def _kept_nodes(keep: Column) -> Column:
    is_text = F.col("token").isNotNull() & ~F.col("token").rlike("^" + H.TAG)
    nodes = F.array_sort(F.collect_list(F.when(is_text & keep, F.struct("pos", "token"))))
    return F.transform(nodes, lambda n: n["token"])


def _one_line(nodes: Column) -> Column:
    return H.collapse_space(H.decode_entities(F.array_join(nodes, " ")))


def _as_is(nodes: Column) -> Column:
    trimmed = F.transform(nodes, lambda n: H.collapse_ends(H.decode_entities(n)))
    return F.array_join(F.filter(trimmed, lambda n: n != ""), " ")


def structural_text(
    pages: DataFrame, key: str, tags: tuple[str, ...], by_attribute: bool, out: str, as_is: bool = False
) -> DataFrame:
    """Text without noise elements, for pages of any shape."""
    marked = without_noise(with_element_end(page_tokens(pages, key), key), noise_element(by_attribute, tags), key)
    nodes = _kept_nodes(~F.col("covered"))
    return marked.groupBy(key).agg((_as_is if as_is else _one_line)(nodes).alias(out))


def visible_text(
    pages: DataFrame, key: str, tags: tuple[str, ...], by_attribute: bool, out: str, as_is: bool = False
) -> DataFrame:
    """Text without noise elements, found by tag name and maybe by class or id.

    Where patterns find the same elements as the tree does, the page is cleaned
    in place; only the other pages are split into tokens and shuffled.
    `as_is` keeps the space inside text nodes instead of squeezing it.
    """
    rows = pages.select(key, F.coalesce("html", F.lit("")).alias("html"))
    bare = once(rows, H.drop_opaque(F.col("html")).alias("_bare"))
    flat = H.balanced(F.col("_bare"), tags)
    if by_attribute:
        flat = flat & ~F.col("_bare").rlike(H.noise_attr_pattern())
    judged = once(bare, flat.alias("_flat"))
    rest = H.drop_closed(F.col("_bare"), tags)
    simple = judged.filter("_flat").select(key, (H.markup_to_lines if as_is else H.markup_to_text)(rest).alias(out))
    return simple.unionByName(structural_text(judged.filter("NOT _flat"), key, tags, by_attribute, out, as_is))


def filtered_text(pages: DataFrame, key: str = "page_id", out: str = "filtered_text") -> DataFrame:
    """The text that is fingerprinted, per page."""
    return visible_text(pages, key, H.NOISE_TAGS, True, out)


def snippet_text(pages: DataFrame, key: str = "page_id", out: str = "snippet_text") -> DataFrame:
    """The text that is searched for snippets, per page."""
    return visible_text(pages, key, H.SNIPPET_NOISE_TAGS, False, out, as_is=True)


def structural_main_text(pages: DataFrame, key: str = "page_id", out: str = "main_text") -> DataFrame:
    """`main_text` by element structure, for pages of any shape."""
    marked = without_noise(with_element_end(page_tokens(pages, key), key), noise_element(False), key)
    ranged = _with_region(marked, key)
    return ranged.groupBy(key).agg(_one_line(_kept_nodes(~F.col("covered") & F.col("_inside"))).alias(out))


def _with_region(marked: DataFrame, key: str) -> DataFrame:
    """Adds `_inside`: the token lies in the element that holds the main text."""
    order = F.array_position(F.array(*[F.lit(t) for t in MAIN_TAGS]), F.col("tag"))
    opens = F.col("tag").isin(*MAIN_TAGS) & ~F.col("closing") & ~F.col("covered")
    first = F.min(F.when(opens, F.struct(order.alias("o"), F.col("pos").alias("a"), F.col("end_pos").alias("b"))))
    ranged = marked.withColumn("_r", first.over(Window.partitionBy(key)))
    inside = F.col("_r").isNull() | ((F.col("pos") > F.col("_r.a")) & (F.col("_r.b").isNull() | (F.col("pos") < F.col("_r.b"))))
    return ranged.withColumn("_inside", inside).drop("_r")


def structural_page_texts(pages: DataFrame, key: str) -> DataFrame:
    """(key, filtered_text, main_text, snippet_text) from one pass over the tokens of html with marked lines."""
    marked = with_element_end(page_tokens(pages, key), key).withColumns({
        "covered": covered(noise_element(False), key),
        "_by_attribute": covered(noise_element(True), key),
        "_for_snippets": covered(noise_element(False, H.SNIPPET_NOISE_TAGS), key),
    })
    nodes = _with_region(marked, key).groupBy(key).agg(
        _kept_nodes(~F.col("_by_attribute")).alias("_f"), _kept_nodes(~F.col("covered") & F.col("_inside")).alias("_m"),
        _kept_nodes(~F.col("_for_snippets")).alias("_s"),
    )
    plain = F.transform("_s", lambda n: F.replace(n, F.lit(H.LINE), F.lit("")))
    return nodes.select(
        key, H.one_line(_one_line(F.col("_f"))).alias("filtered_text"), H.lines(_one_line(F.col("_m"))).alias("main_text"),
        _as_is(plain).alias("snippet_text"),
    )


def _open_tag(tag: str) -> str:
    return rf"(?i)<{tag}(?:\s[^>]*)?>"


def _repeated_main(html: str) -> Column:
    """More than one element of a kind that may hold the main text."""
    return reduce(lambda a, b: a | b, [F.regexp_count(html, F.lit(_open_tag(t))) > 1 for t in MAIN_TAGS])


def _main_region(content: str) -> Column:
    """Inner html of the first main, article or body, for pages with one of each at most."""
    region = F.col(content)
    for tag in reversed(MAIN_TAGS):
        body = F.regexp_extract(content, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}\s*>|\z)", 1)
        region = F.when(F.col(content).rlike(_open_tag(tag)), body).otherwise(region)
    return region


def main_text(pages: DataFrame, key: str = "page_id", out: str = "main_text") -> DataFrame:
    """Text of the first main, else article, else body, else the whole page.

    An unclosed one of these runs to the end of the page.  Where each occurs at
    most once its text is cut out in place; only other pages are tokenised.
    """
    rows = pages.select(key, F.coalesce("html", F.lit("")).alias("html"))
    bare = once(rows, H.drop_opaque(F.col("html")).alias("_bare"))
    judged = once(bare, (H.balanced(F.col("_bare"), H.NOISE_TAGS) & ~_repeated_main("_bare")).alias("_flat"))
    content = once(judged.filter("_flat"), H.drop_closed(F.col("_bare"), H.NOISE_TAGS).alias("_content"))
    simple = content.select(key, H.markup_to_text(_main_region("_content")).alias(out))
    return simple.unionByName(structural_main_text(judged.filter("NOT _flat"), key, out))


def page_texts(pages: DataFrame, keywords: Column, key: str = "page_id") -> DataFrame:
    """(key, filtered_text, main_text, snippets): all a scan reads off a page.

    The same texts as `filtered_text`, `main_text` and `page_snippets` give, but
    the main text keeps the line ends a reader sees, so that a list of dates is
    not one sentence.
    Plain pages go through one chain of steps that share the cleaned html; only
    pages that need their structure are tokenised, all three texts at once.
    """
    rows = pages.select(key, F.coalesce("html", F.lit("")).alias("html"))
    bare = once(rows, H.mark_lines(H.drop_opaque(F.col("html"))).alias("_bare"))
    flat = H.balanced(F.col("_bare"), H.NOISE_TAGS) & ~F.col("_bare").rlike(H.noise_attr_pattern()) & ~_repeated_main("_bare")
    judged = once(bare, flat.alias("_flat"))
    content = once(judged.filter("_flat"), H.drop_closed(F.col("_bare"), H.NOISE_TAGS).alias("_content"))
    unmarked = F.replace(F.col("_bare"), F.lit(H.LINE), F.lit(""))
    plain = content.select(
        key, H.markup_to_one_line(F.col("_content")).alias("filtered_text"),
        H.lines(H.markup_to_text(_main_region("_content"))).alias("main_text"),
        H.markup_to_lines(H.drop_closed(unmarked, H.SNIPPET_NOISE_TAGS)).alias("snippet_text"),
    )
    marked = judged.filter("NOT _flat").select(key, H.mark_lines(F.col("html")).alias("html"))
    texts = plain.unionByName(structural_page_texts(marked, key))
    return H.with_snippets(texts, H.sentences(F.col("snippet_text")), keywords).drop("snippet_text")


def page_sentences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, sentence) of the snippet text, sentences of 10 characters up."""
    return snippet_text(pages, key).select(key, F.posexplode(H.sentences(F.col("snippet_text"))).alias("pos", "sentence"))


def page_snippets(pages: DataFrame, keywords: Column, key: str = "page_id", limit: int = 50) -> DataFrame:
    """(key, snippets): the first sentences that hold one of the lower-case keywords."""
    texts = snippet_text(pages, key)
    return H.with_snippets(texts, H.sentences(F.col("snippet_text")), keywords, limit=limit).select(key, "snippets")


def anchor_contexts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, context): text around the pos-th link of a page.

    The context is the text of the innermost closed p, div, li, td or article
    around the link, cut after 200 characters.  Elements are found as "the last
    one opened at the depth the link is at", by a window, once per tag name.
    """
    text = F.when(
        ~F.col("token").rlike("^" + H.TAG), H.collapse_ends(H.decode_entities(F.col("token")))
    )
    tokens = page_tokens(pages, key).withColumn("_text", text)
    in_order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_anchor = F.col("token").rlike(r"(?i)^<a\s")
    tokens = tokens.withColumn("_chars", F.sum(F.coalesce(F.length("_text"), F.lit(0))).over(in_order))
    tokens = tokens.withColumn("_anchor", F.when(is_anchor, F.sum(F.when(is_anchor, 1).otherwise(0)).over(in_order)))
    marked = with_element_end(tokens, key)
    chars_at_end = F.lead("_chars").over(Window.partitionBy(key, "tag", "depth").orderBy("pos"))
    marked = marked.withColumn("_end_chars", F.when(F.col("end_pos").isNotNull(), chars_at_end))

    step = F.when(F.col("closing"), -1).otherwise(1)
    frames = marked.filter(F.col("tag").isin(*CONTEXT_TAGS)).select(
        key, "tag", "pos", step.alias("step"), F.lit(None).cast("bigint").alias("anchor"),
        F.when(
            ~F.col("closing"),
            F.struct(F.col("pos").alias("start"), F.col("_chars").alias("c0"), F.col("_end_chars").alias("c1")),
        ).alias("opened"),
    )
    probes = marked.filter("_anchor IS NOT NULL").select(
        key, F.explode(F.array(*[F.lit(t) for t in CONTEXT_TAGS])).alias("tag"), "pos", F.lit(0).alias("step"),
        F.col("_anchor").alias("anchor"), F.lit(None).cast(frames.schema["opened"].dataType).alias("opened"),
    )
    events = frames.unionByName(probes)
    by_tag = Window.partitionBy(key, "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("depth", F.sum("step").over(by_tag) + F.when(F.col("step") == -1, 1).otherwise(0))
    by_depth = Window.partitionBy(key, "tag", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.last("opened", ignorenulls=True).over(by_depth)
    found = events.withColumn("around", around).filter("anchor IS NOT NULL")
    usable = F.when((F.col("depth") > 0) & F.col("around.c1").isNotNull(), F.col("around"))
    nearest = found.groupBy(key, "anchor").agg(F.max(usable).alias("box"))
    boxes = nearest.groupBy(key).agg(F.collect_list(F.struct("anchor", "box")).alias("boxes"))

    nodes = F.array_sort(F.collect_list(F.when(F.col("_text") != "", F.struct("pos", "_text"))))
    texts = tokens.groupBy(key).agg(F.array_join(F.transform(nodes, lambda n: n["_text"]), "").alias("text"))
    rows = boxes.join(texts, key).select(key, "text", "boxes")

    def cut(box: Column) -> Column:
        size = box["box"]["c1"] - box["box"]["c0"]
        part = F.substring(F.col("text"), (box["box"]["c0"] + 1).cast("int"), F.least(size, F.lit(CONTEXT_CHARS)).cast("int"))
        shown = F.when(size > CONTEXT_CHARS, F.concat(part, F.lit("..."))).otherwise(part)
        return F.struct(box["anchor"].alias("pos"), F.coalesce(shown, F.lit("")).alias("context"))

    return rows.select(key, F.inline(F.transform("boxes", cut)))
