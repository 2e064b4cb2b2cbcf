"""Link discovery: anchors, filters, scores, the best per seed, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import scoring as S
from pagetide.functions import urls as U
from pagetide.functions.once import once
from pagetide.operators.running import Running, running
from pagetide.operators.text import anchor_contexts

MAX_LINKS = 10
MIN_SCORE = 2.0


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), H.decode_entities(H.unmasked(value)))


def page_anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, pos, href, text, title): links with an href, in page order.

    The page is cut at each "<a "; the text runs to the end tag.  Rows come
    straight from the page row, without a shuffle.
    """
    pieces = F.split(H.drop_opaque(F.col(html)), r"(?i)<a(?:\s)")
    rows = pages.select(key, url, F.posexplode(pieces).alias("pos", "piece")).filter("pos > 0")
    open_tag = F.concat(F.lit(" "), F.regexp_extract("piece", r"^([^>]*)>", 1))
    inner = F.regexp_extract("piece", r"(?is)^[^>]*>(.*?)(?:</a\s*>|\z)", 1)
    text = H.collapse_ends(F.regexp_replace(inner, rf"{H.SPACE}*(?:{H.TAG_OR_BREAK}){H.SPACE}*", ""))
    parsed = once(
        once(rows, open_tag.alias("_tag"), text.alias("_text")),
        _attribute(F.col("_tag"), "href").alias("href"),
        H.collapse_ends(H.decode_entities(F.col("_text"))).alias("text"),
        F.coalesce(_attribute(F.col("_tag"), "title"), F.lit("")).alias("title"),
    )
    return parsed.filter("href IS NOT NULL").select(key, url, "pos", "href", "text", "title")


def resolved(anchors: DataFrame, base: str = "url", href: str = "href") -> DataFrame:
    """Adds `link`, the normalised absolute url; other schemes drop out."""
    absolute = once(anchors, U.resolve(F.col(base), F.col(href)).alias("_absolute"))
    return once(absolute, U.normalise(F.col("_absolute")).alias("link")).drop("_absolute").filter("link <> ''")


def first_per_link(anchors: DataFrame, key: str) -> DataFrame:
    """The first anchor of each link of a page, by an aggregate."""
    rest = [c for c in anchors.columns if c not in (key, "link")]
    return anchors.groupBy(key, "link").agg(F.min_by(F.struct(*rest), "pos").alias("_a")).select(key, "link", "_a.*")


def passes_filters(
    link: Column, text: Column, seed: Column, exclude: Column, same_domain: Column, include_url: Column, include_anchor: Column
) -> Column:
    """All four rules; an empty or NULL list lets everything through."""
    low_link, low_text = F.lower(link), F.lower(text)

    def any_in(words: Column, where: Column) -> Column:
        return F.coalesce(F.exists(words, lambda w: F.contains(where, F.lower(w))), F.lit(False))

    def none_set(words: Column) -> Column:
        return F.coalesce(F.size(words) <= 0, F.lit(True))

    return (
        ~any_in(exclude, low_link)
        & (~F.coalesce(same_domain, F.lit(False)) | (U.host(link) == U.host(seed)))
        & (none_set(include_url) | any_in(include_url, low_link))
        & (none_set(include_anchor) | any_in(include_anchor, low_text))
    )


def scored(links: DataFrame, custom_words: Column | None = None, year: int = S.DEFAULT_YEAR) -> DataFrame:
    """Adds `score` from link, text, title and context."""
    worded = once(links, S.link_words(F.col("text"), F.col("title"), F.col("context")).alias("_words"))
    score = S.link_score(F.col("link"), F.col("text"), F.col("_words"), custom_words, year)
    return once(worded, score.alias("score")).drop("_words")


def above(links: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    return links.filter(F.col("score") >= threshold)


def ranked(links: DataFrame, seed: str, chunk_links: int = 100_000) -> DataFrame:
    """Adds `rank` within the seed: best score first, page order on ties.

    The rank is a running count, taken over chunks of one score and a stretch
    of positions, so that the links of one seed need not fit in one task.
    `pos` must be unique within the seed.
    """
    keyed = links.withColumn("_low", -F.col("score"))
    chunk = F.struct("_low", F.floor(F.col("pos") / chunk_links).alias("stretch"))
    counted = running(keyed, [seed], ["_low", "pos"], chunk, [Running("rank", "sum", F.lit(1))])
    return counted.withColumn("rank", F.col("rank").cast("int")).drop("_low")


def top_links(links: DataFrame, seed: str, limit: int = MAX_LINKS) -> DataFrame:
    """The best `limit` links of each seed with a score above zero.

    The rank filter makes Spark keep only `limit` rows per seed and task before
    the shuffle, so one seed with very many links is no burden.
    """
    best = Window.partitionBy(seed).orderBy(F.desc("score"), "pos")
    return links.filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def discover(
    pages: DataFrame,
    key: str,
    exclude: Column,
    same_domain: Column,
    include_url: Column,
    include_anchor: Column,
    custom_words: Column | None = None,
    limit: int = MAX_LINKS,
    year: int = S.DEFAULT_YEAR,
) -> DataFrame:
    """Anchors of each seed page through all steps to its best links."""
    candidates = first_per_link(resolved(page_anchors(pages, key)), key)
    kept = candidates.filter(passes_filters(F.col("link"), F.col("text"), F.col("url"), exclude, same_domain, include_url, include_anchor))
    with_context = kept.join(anchor_contexts(pages, key), [key, "pos"], "left")
    return top_links(scored(with_context, custom_words, year), key, limit)


def merge_tracked(found: DataFrame, tracked: DataFrame, seed: str, limit: int = MAX_LINKS) -> DataFrame:
    """Union by link: a link seen before keeps its first_seen, takes the new score.

    Known links come before new ones on equal scores, each in their own order.
    """
    both = tracked.alias("t").join(found.alias("f"), [seed, "link"], "full_outer").select(
        seed, "link",
        F.coalesce("f.score", "t.score").alias("score"),
        F.coalesce("t.first_seen", "f.first_seen").alias("first_seen"),
        F.when(F.col("t.pos").isNotNull(), F.struct(F.lit(0).alias("new"), F.col("t.pos").alias("pos")))
        .otherwise(F.struct(F.lit(1).alias("new"), F.col("f.pos").alias("pos"))).alias("_order"),
    )
    best = Window.partitionBy(seed).orderBy(F.desc("score"), "_order")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).drop("_order")
