"""Deadline extraction (D).

The sentences are built from order dates in eleven wordings; the checks know
from the order which date a sentence means and do not parse it again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import plain, query
from pagetide.functions import dates as D
from pagetide.operators import deadlines as L
from pagetide.plans import derived as V

AS_OF = "1997-01-31"
FIRST, LAST = "DATE '1997-01-31'", "DATE '1997-01-31' + 730"

SENTENCES = """
worded AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 11 AS kind, CAST(o_orderdate AS DATE) AS day,
    CASE o_orderkey % 6 WHEN 0 THEN 'Abstract submission deadline: ' WHEN 1 THEN 'Full paper deadline: '
      WHEN 2 THEN 'Early bird registration closes: ' WHEN 3 THEN 'Camera-ready due: ' WHEN 4 THEN 'Last updated: '
      ELSE 'Submit your proposal by ' END AS head,
    ['abstract', 'paper', 'registration', 'camera-ready', 'excluded', 'general'][o_orderkey % 6 + 1] AS kind_of_head
  FROM orders),
sentences AS (
  SELECT *, head || CASE kind
    WHEN 0 THEN strftime(day, '%B %-d, %Y') WHEN 1 THEN strftime(day, '%Y-%m-%d') WHEN 2 THEN strftime(day, '%-d %B %Y')
    WHEN 3 THEN strftime(day, '%-m/%-d/%Y') WHEN 4 THEN strftime(day, '%B %-d') WHEN 5 THEN strftime(day, '%-d %b')
    WHEN 6 THEN strftime(day, '%B %Y') WHEN 7 THEN 'in ' || dayofyear(day) || ' days' WHEN 8 THEN 'tomorrow'
    WHEN 9 THEN strftime(day, '%b %-dth, %Y') ELSE 'a date to be announced' END AS sentence,
    CASE WHEN kind IN (0, 1, 2, 3, 9) THEN day
      WHEN kind IN (4, 5) THEN TRY_CAST('1997-' || strftime(day, '%m-%d') AS DATE)
      WHEN kind = 6 THEN least(last_day(day), date_trunc('month', day)::DATE + 30)
      WHEN kind IN (7, 8) AND kind_of_head = 'excluded' THEN NULL -- a relative date without deadline wording
      WHEN kind = 7 THEN DATE '1997-01-31' + CAST(dayofyear(day) AS INTEGER) WHEN kind = 8 THEN DATE '1997-02-01' END AS meant,
    CASE WHEN kind IN (7, 8) THEN 0.7 ELSE 0.9 END AS base
  FROM worded)"""


def worded(spark, d):
    """(doc_id, sentence) in the same wordings."""
    day = "cast(o_orderdate AS date)"
    return V.table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc_id",
        f"""concat(CASE o_orderkey % 6 WHEN 0 THEN 'Abstract submission deadline: ' WHEN 1 THEN 'Full paper deadline: '
              WHEN 2 THEN 'Early bird registration closes: ' WHEN 3 THEN 'Camera-ready due: ' WHEN 4 THEN 'Last updated: '
              ELSE 'Submit your proposal by ' END,
            CASE o_orderkey % 11 WHEN 0 THEN date_format({day}, 'MMMM d, yyyy') WHEN 1 THEN date_format({day}, 'yyyy-MM-dd')
              WHEN 2 THEN date_format({day}, 'd MMMM yyyy') WHEN 3 THEN date_format({day}, 'M/d/yyyy')
              WHEN 4 THEN date_format({day}, 'MMMM d') WHEN 5 THEN date_format({day}, 'd MMM') WHEN 6 THEN date_format({day}, 'MMMM yyyy')
              WHEN 7 THEN concat('in ', dayofyear({day}), ' days') WHEN 8 THEN 'tomorrow'
              WHEN 9 THEN concat(date_format({day}, 'MMM d'), 'th, ', year({day})) ELSE 'a date to be announced' END) AS sentence""",
    )


def as_of():
    return F.lit(AS_OF).cast("date")


def deadline_pages(spark, d):
    """A page per order: its sentence as a snippet, and again in the main text."""
    rows = worded(spark, d)
    main = F.concat(F.col("sentence"), F.lit("! Soon.\nPage 3 of 9 says 2 March 1997. Manuscript due 1998-05-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("? "), F.col("sentence"))
    return rows.select("doc_id", F.array("sentence", F.lit("short one")).alias("snippets"), main.alias("main_text"))


PAGES = SENTENCES + """,
pieces AS (
  SELECT doc_id, 0 AS part, 0 AS i, true AS is_snippet, sentence, meant, kind_of_head, base FROM sentences
  UNION ALL SELECT doc_id, 1, 0, false, sentence, meant, kind_of_head, base FROM sentences
  UNION ALL SELECT doc_id, 1, 1, false, 'Page 3 of 9 says 2 March 1997', DATE '1997-03-02', 'excluded', 0.9 FROM sentences
  UNION ALL SELECT doc_id, 1, 2, false, 'Manuscript due 1998-05-0' || (doc_id % 9 + 1), DATE '1998-05-01' + CAST(doc_id % 9 AS INTEGER), 'paper', 0.9 FROM sentences
  UNION ALL SELECT doc_id, 1, 3, false, sentence, meant, kind_of_head, base FROM sentences)"""

CANDIDATES = PAGES + f""",
candidates AS (
  SELECT doc_id, part, i, is_snippet, sentence, meant, kind_of_head,
    round(least(1.0, least(1.0, base + CASE WHEN is_snippet THEN 0.1 ELSE 0 END) + CASE WHEN regexp_matches(sentence, '(?i)\\bdeadline\\b') THEN 0.1 ELSE 0 END), 4) AS confidence
  FROM pieces WHERE kind_of_head <> 'excluded' AND meant BETWEEN {FIRST} AND {LAST}),
deduped AS (
  SELECT * FROM candidates
  QUALIFY row_number() OVER (PARTITION BY doc_id, meant, kind_of_head ORDER BY confidence DESC, part, i) = 1)"""


@query("d1_split_sources", f"""WITH {PAGES} SELECT doc_id, is_snippet, CAST(i AS INTEGER) AS i, sentence FROM pieces""")
def split(spark, d):
    """Main-text numbers skip what is too short, so they count kept sentences."""
    return L.split_sources(deadline_pages(spark, d), "doc_id").select("doc_id", "is_snippet", F.col("seq.i").alias("i"), "sentence")


@query("d2_excluded_context", f"""WITH {PAGES} SELECT doc_id, part, CAST(i AS INTEGER) AS i, kind_of_head = 'excluded' AS excluded FROM pieces""")
def excluded(spark, d):
    rows = L.split_sources(deadline_pages(spark, d), "doc_id")
    return rows.select("doc_id", F.when(F.col("is_snippet"), 0).otherwise(1).alias("part"), F.col("seq.i").alias("i"),
                       D.excluded(F.col("sentence")).alias("excluded"))


@query("d3_parsed_dates", f"""WITH {SENTENCES}
SELECT doc_id, sentence, coalesce(CAST(meant AS VARCHAR), 'none') AS day, CAST(CASE WHEN meant IS NULL THEN 0 ELSE base END AS DOUBLE) AS base FROM sentences""")
def parsed(spark, d):
    return D.with_date(worded(spark, d), as_of()).select(
        "doc_id", "sentence", F.coalesce(F.col("date").cast("string"), F.lit("none")).alias("day"), F.coalesce("base", F.lit(0.0)).alias("base")
    )


@query("d4_valid_window", f"""WITH {SENTENCES}
SELECT doc_id, CAST(meant AS VARCHAR) AS day FROM sentences WHERE meant BETWEEN {FIRST} AND {LAST}""")
def window(spark, d):
    rows = D.with_date(worded(spark, d), as_of()).select("doc_id", F.col("date").alias("day"))
    return plain(rows.filter(D.in_window(F.col("day"), as_of(), F.date_add(as_of(), D.WINDOW_DAYS))))


@query("d5_deadline_types", f"""WITH {SENTENCES}
SELECT doc_id, CASE WHEN kind_of_head = 'excluded' THEN 'general' ELSE kind_of_head END AS type FROM sentences""")
def types(spark, d):
    return worded(spark, d).select("doc_id", D.classify(F.col("sentence")).alias("type"))


@query("d6_confidence", f"""WITH {CANDIDATES}
SELECT doc_id, part, CAST(i AS INTEGER) AS i, CAST(confidence AS DOUBLE) AS confidence FROM candidates""")
def confidence(spark, d):
    rows = L.candidate_deadlines(L.split_sources(deadline_pages(spark, d), "doc_id"), as_of())
    return rows.select("doc_id", F.when(F.col("is_snippet"), 0).otherwise(1).alias("part"), F.col("seq.i").alias("i"), "confidence")


@query("d7_distinct_deadlines", f"""WITH {CANDIDATES}
SELECT doc_id, CAST(meant AS VARCHAR) AS date, kind_of_head AS type, CAST(confidence AS DOUBLE) AS confidence, sentence AS source_text FROM deduped""")
def distinct(spark, d):
    found = L.candidate_deadlines(L.split_sources(deadline_pages(spark, d), "doc_id"), as_of())
    return plain(L.dedup_deadlines(found, "doc_id").drop("seq"))


@query("d8_deadline_lists", f"""WITH {CANDIDATES}
SELECT doc_id, string_agg(meant || ' ' || kind_of_head, '; ' ORDER BY meant, part, i) AS deadlines, count(*) AS n FROM deduped GROUP BY 1""")
def lists(spark, d):
    out = L.extract_deadlines(deadline_pages(spark, d), "doc_id", as_of())
    shown = F.transform("deadlines", lambda x: F.concat_ws(" ", x["date"].cast("string"), x["type"]))
    return out.select("doc_id", F.array_join(shown, "; ").alias("deadlines"), F.size("deadlines").alias("n"))


@query("d8_sentence_table", f"""
SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
  ['abstract', 'paper', 'registration', 'camera-ready', 'excluded', 'general'][o_orderkey % 6 + 1] AS type
FROM orders WHERE o_orderkey % 6 <> 4 AND CAST(o_orderdate AS DATE) BETWEEN {FIRST} AND {LAST}""")
def sentence_table(spark, d):
    """The plain one-sentence-per-order table through the whole extraction."""
    pages = V.deadline_text(spark, d).select("doc_id", F.array().cast("array<string>").alias("snippets"), F.col("sentence").alias("main_text"))
    out = L.extract_deadlines(pages, "doc_id", as_of()).select("doc_id", F.inline("deadlines"))
    return plain(out.select("doc_id", "date", "type"))
