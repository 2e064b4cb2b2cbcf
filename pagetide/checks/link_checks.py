"""Link discovery (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import plain, query
from pagetide.functions import urls as U
from pagetide.operators import links as K
from pagetide.operators import text as T
from pagetide.plans import derived as V

ANCHORS = f"""
anchors AS (
  SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '{Q.OPAQUE}', ' ', 'g'), '<a href="[^"]*">[^<]*</a>') AS l FROM pages)),
parsed AS (
  SELECT page_id, url, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS text FROM anchors)"""


def anchors(spark, d):
    return K.page_anchors(V.table(spark, d, "pages"))


@query("e1_page_anchors", f"WITH {ANCHORS} SELECT page_id, url, pos, href, text, '' AS title FROM parsed")
def page_anchors(spark, d):
    return anchors(spark, d)




@query("e2_resolved_links", f"""WITH {ANCHORS},
p AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/]*') AS origin, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
  regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path, regexp_extract(text, '^[a-zA-Z]*') AS w FROM parsed),
v AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder, regexp_replace(path, '[^/]*/[^/]*$', '') AS parent FROM p)
SELECT page_id, pos, variant, link FROM (
  SELECT page_id, pos, 'a' AS variant, origin || href AS link FROM v
  UNION ALL SELECT page_id, pos, 'up', origin || (CASE WHEN parent = '' THEN '/' ELSE parent END) || 'up/' || w FROM v
  UNION ALL SELECT page_id, pos, 'here', origin || folder || w FROM v
  UNION ALL SELECT page_id, pos, 'query', origin || path || '?q=' || w FROM v
  UNION ALL SELECT page_id, pos, 'fragment', regexp_replace(url, '#.*$', '') || '#' || w FROM v
  UNION ALL SELECT page_id, pos, 'host', scheme || '://other.example.org/' || w || '/' FROM v
  UNION ALL SELECT page_id, pos, 'root', origin || '/root/' || w || '?x=1#y' FROM v
  UNION ALL SELECT page_id, pos, 'mail', 'mailto:' || w FROM v)""")
def resolved(spark, d):
    """Each anchor in eight forms of reference, resolved against its page."""
    word = F.regexp_extract("text", "^[a-zA-Z]*", 0)
    forms = {
        "a": F.col("href"), "up": F.concat(F.lit("../up/"), word), "here": F.concat(F.lit("./"), word),
        "query": F.concat(F.lit("?q="), word), "fragment": F.concat(F.lit("#"), word),
        "host": F.concat(F.lit("//other.example.org/"), word, F.lit("/")),
        "root": F.concat(F.lit("/root/"), word, F.lit("?x=1#y")), "mail": F.concat(F.lit("mailto:"), word),
    }
    rows = anchors(spark, d).select(
        "page_id", "url", "pos", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("form")) for n, c in forms.items()]))
    )
    return rows.select("page_id", "pos", "variant", U.resolve(F.col("url"), F.col("form")).alias("link"))


NORMAL = "regexp_replace(regexp_extract(href, '^(https?://[^?#]*)', 1), '/$', '')"
LINK_ROWS = """
link_rows AS (
  SELECT p_partkey AS pos, p_partkey % 20 AS seed_id,
    concat('https://conf', cast(p_partkey % 20 as varchar), '.example.org/',
      case p_partkey % 8 when 0 then 'cfp' when 1 then 'submit/abstract' when 2 then 'important-dates'
        when 3 then '2026/programme' when 4 then 'call-for-papers.pdf' when 5 then 'donate' else 'about' end,
      '?p=', cast(p_size as varchar), '#x') AS href,
    case p_partkey % 8 when 0 then 'Call for Papers' when 1 then 'Submit abstract' when 2 then 'Key dates'
      when 4 then 'Call for papers 2026' else p_name end AS text
  FROM part)"""


@query("e3_normalised_urls", f"""WITH {LINK_ROWS} SELECT pos, {NORMAL} AS link FROM link_rows
UNION ALL SELECT page_id, {NORMAL.replace('href', 'url')} FROM pages""")
def normalised(spark, d):
    rows = V.link_rows(spark, d).select("pos", F.col("href").alias("u"))
    pages = V.table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("u"))
    return rows.unionByName(pages).select("pos", U.normalise(F.col("u")).alias("link"))


FIRSTS = f"""{LINK_ROWS},
firsts AS (SELECT seed_id, {NORMAL} AS link, min(pos) AS pos, arg_min(text, pos) AS text FROM link_rows GROUP BY 1, 2)"""


def first_links(spark, d):
    rows = V.link_rows(spark, d).withColumn("url", F.concat(F.lit("https://conf"), F.col("seed_id").cast("string"), F.lit(".example.org/")))
    return K.first_per_link(K.resolved(rows), "seed_id")


@query("e4_first_anchor_per_link", f"WITH {FIRSTS} SELECT seed_id, link, pos, text FROM firsts")
def firsts(spark, d):
    return first_links(spark, d).select("seed_id", "link", "pos", "text")


EXCLUDE, INCLUDE_URL, INCLUDE_TEXT = ("Donate", "privacy"), ("call", "SUBMIT", "dates", "programme", "cfp"), ("papers", "submit", "dates", "part")


def words(values):
    return F.array(*[F.lit(v) for v in values])


def any_of(values, column):
    return "(" + " OR ".join(f"contains(lower({column}), '{v.lower()}')" for v in values) + ")"


@query("e5_filtered_links", f"""WITH {ANCHORS},
r AS (SELECT page_id, pos, regexp_extract(url, '^[a-z]+://[^/]*') || href AS link, text FROM parsed)
SELECT page_id AS source, pos, link FROM r WHERE NOT {any_of(('de', 'xx'), 'link')} AND {any_of(('a', 'e'), 'text')}
UNION ALL
SELECT seed_id, pos, link FROM (SELECT seed_id, pos, {NORMAL} AS link, text FROM ({f"WITH {LINK_ROWS} SELECT * FROM link_rows"}))
WHERE NOT {any_of(EXCLUDE, 'link')} AND {any_of(INCLUDE_URL, 'link')} AND {any_of(INCLUDE_TEXT, 'text')}
  AND contains(link, '//conf' || seed_id || '.')""")
def filtered(spark, d):
    """Page anchors without url rules, and the link rows under all four rules."""
    none = F.array().cast("array<string>")
    pages = K.resolved(anchors(spark, d))
    kept = pages.filter(K.passes_filters(F.col("link"), F.col("text"), F.col("url"), words(("de", "xx")), F.lit(False), none, words(("a", "e"))))
    rows = V.link_rows(spark, d).withColumn("url", F.concat(F.lit("https://conf"), F.col("seed_id").cast("string"), F.lit(".example.org/")))
    rows = K.resolved(rows)
    ruled = rows.filter(
        K.passes_filters(F.col("link"), F.col("text"), F.col("url"), words(EXCLUDE), F.lit(True), words(INCLUDE_URL), words(INCLUDE_TEXT))
    )
    return kept.select(F.col("page_id").alias("source"), "pos", "link").unionByName(ruled.select(F.col("seed_id").alias("source"), "pos", "link"))


@query("e6_link_context", f"""
WITH a AS (SELECT page_id, unnest(l) AS li, generate_subscripts(l, 1) AS pos FROM (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '{Q.OPAQUE}', ' ', 'g'), '<li>[^<]*<a href="[^"]*">[^<]*</a>[^<]*</li>') AS l FROM pages)),
t AS (SELECT page_id, pos, regexp_replace(regexp_replace(li, '\\s*<[^>]*>\\s*', '', 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM a)
SELECT page_id, pos, CASE WHEN length(x) > 200 THEN left(x, 200) || '...' ELSE x END AS context FROM t""")
def contexts(spark, d):
    return T.anchor_contexts(V.table(spark, d, "pages"))


POINTS = """(
  CASE WHEN regexp_matches(u, '/cfp|call-for-papers|call_for_papers') THEN 3.0 ELSE 0 END
  + CASE WHEN regexp_matches(u, '/submit|submission') THEN 2.5 ELSE 0 END
  + CASE WHEN regexp_matches(u, '/deadline|important-dates|key-dates') THEN 2.5 ELSE 0 END
  + CASE WHEN regexp_matches(u, '/program|programme|papers') THEN 2.0 ELSE 0 END
  + CASE WHEN regexp_matches(u, '/abstract') THEN 2.0 ELSE 0 END
  + CASE WHEN regexp_matches(u, '/\\d{4}/') THEN 1.5 ELSE 0 END
  + CASE WHEN regexp_matches(u, '/annual-meeting|annual_meeting') THEN 2.0 ELSE 0 END
  + 2.0 * len(list_filter(['call for papers', 'call for abstracts', 'call for proposals', 'cfp', 'submit', 'submission', 'deadline', 'important dates', 'key dates'], lambda k: contains(w, k)))
  + len(list_filter(['participate', 'contribute', 'authors', 'speakers', 'presenters', 'abstract', 'paper', 'proposal'], lambda k: contains(w, k)))
  + 1.5 * len(list_filter(['part_1', 'green'], lambda k: contains(w, k))))"""

SCORED = f"""{FIRSTS},
scored AS (
  SELECT seed_id, link, pos, text, CAST(round({POINTS} * CASE WHEN length(link) > 150 THEN 0.5 ELSE 1 END
      * CASE WHEN regexp_matches(u, '\\.(pdf|doc|docx|ppt|pptx|zip)$') THEN 0.7 ELSE 1 END
      + CASE WHEN length(text) BETWEEN 6 AND 49 AND (contains(lower(text), 'call') OR contains(lower(text), 'submit') OR contains(lower(text), 'deadline')) THEN 0.5 ELSE 0 END
      + CASE WHEN contains(link, '2026') OR contains(w, '2026') THEN 1.0 ELSE 0 END, 2) AS DOUBLE) AS score
  FROM (SELECT *, lower(link) AS u, lower(text) AS w FROM firsts))"""


def scored_links(spark, d):
    rows = first_links(spark, d).withColumn("title", F.lit("")).withColumn("context", F.lit(""))
    return K.scored(rows, words(("part_1", "Green")))


@query("e7_link_scores", f"WITH {SCORED} SELECT seed_id, link, score FROM scored")
def scores(spark, d):
    return scored_links(spark, d).select("seed_id", "link", "score")


@query("e8_links_above_threshold", f"WITH {SCORED} SELECT seed_id, link, score FROM scored WHERE score >= 2.0")
def above(spark, d):
    return K.above(scored_links(spark, d)).select("seed_id", "link", "score")


@query("e9_ranked_links", f"""WITH {SCORED}
SELECT seed_id, link, score, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM scored""")
def ranks(spark, d):
    return K.ranked(scored_links(spark, d), "seed_id").select("seed_id", "link", "score", "rank")


@query("e10_top_links", f"""WITH {SCORED}
SELECT seed_id, link, score, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM scored
WHERE score > 0 QUALIFY rank <= 2""")
def top(spark, d):
    return K.top_links(scored_links(spark, d), "seed_id", 2).select("seed_id", "link", "score", "rank")


@query("e10_discovered_links", f"""WITH {ANCHORS},
f AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*') || href, '/$', '') AS link, min(pos) AS pos, arg_min(text, pos) AS text FROM parsed GROUP BY 1, 2),
s AS (SELECT *, 1.5 * (CASE WHEN contains(lower(text || '  ' || text), 'e') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text || '  ' || text), 'tion') THEN 1 ELSE 0 END) AS score FROM f)
SELECT page_id, link, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS INTEGER) AS rank
FROM s WHERE NOT contains(lower(link), 'pills') AND score > 0 QUALIFY rank <= 3""")
def discovered(spark, d):
    """Whole discovery over the pages, scored by two words of the test language."""
    none = F.array().cast("array<string>")
    out = K.discover(V.table(spark, d, "pages"), "page_id", words(("pills",)), F.lit(True), none, none, words(("e", "tion")), limit=3)
    return out.select("page_id", "link", "score", "rank")


@query("e11_merged_links", f"""WITH {SCORED},
found AS (SELECT seed_id, link, score, pos FROM scored),
tracked AS (
  SELECT seed_id, link, CAST(count(*) AS DOUBLE) / 8 AS score, min(day) AS first_seen, min(pos) AS pos
  FROM (SELECT n.seed_id, CASE WHEN n.pos % 3 = 0 THEN {NORMAL} ELSE 'https://old.example.org/' || (n.pos % 40) END AS link, n.pos,
    DATE '2023-01-01' + CAST(n.pos % 300 AS INTEGER) AS day FROM link_rows n) GROUP BY 1, 2),
m AS (
  SELECT coalesce(t.seed_id, f.seed_id) AS seed_id, coalesce(t.link, f.link) AS link, coalesce(f.score, t.score) AS score,
    coalesce(t.first_seen, DATE '2024-01-31') AS first_seen, t.link IS NULL AS is_new, coalesce(t.pos, f.pos) AS pos
  FROM tracked t FULL OUTER JOIN found f ON t.seed_id = f.seed_id AND t.link = f.link)
SELECT seed_id, link, score, {Q.ts('CAST(first_seen AS TIMESTAMP)')} AS first_seen,
  CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, is_new, pos) AS INTEGER) AS rank FROM m QUALIFY rank <= 10""")
def merged(spark, d):
    """Found links merged with older ones, some of them the same links."""
    found = scored_links(spark, d).select("seed_id", "link", "score", "pos").withColumn("first_seen", V.as_of())
    older = F.concat(F.lit("https://old.example.org/"), (F.col("pos") % 40).cast("string"))
    rows = V.link_rows(spark, d).withColumn("link", F.when(F.col("pos") % 3 == 0, U.normalise(F.col("href"))).otherwise(older))
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("pos") % 300).cast("int")).cast("timestamp")
    tracked = rows.groupBy("seed_id", "link").agg(
        (F.count(F.lit(1)) / 8).alias("score"), F.min(day).alias("first_seen"), F.min("pos").alias("pos")
    )
    return plain(K.merge_tracked(found, tracked, "seed_id", 10))
