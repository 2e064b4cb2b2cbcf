"""Relevance score of a candidate link, as a sum of CASE terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Url pattern -> points.
URL_POINTS = (
    (r"/cfp|call-for-papers|call_for_papers", 3.0),
    (r"/submit|submission", 2.5),
    (r"/deadline|important-dates|key-dates", 2.5),
    (r"/program|programme|papers", 2.0),
    (r"/abstract", 2.0),
    (r"/\d{4}/", 1.5),
    (r"/annual-meeting|annual_meeting", 2.0),
)

# Words in the link text, its title or its surroundings.
HIGH_WORDS = ("call for papers", "call for abstracts", "call for proposals", "cfp", "submit",
              "submission", "deadline", "important dates", "key dates")
HIGH_POINTS = 2.0
MEDIUM_WORDS = ("participate", "contribute", "authors", "speakers", "presenters", "abstract",
                "paper", "proposal")
MEDIUM_POINTS = 1.0
CUSTOM_POINTS = 1.5

LONG_URL_CHARS, LONG_URL_FACTOR = 150, 0.5
FILE_PATTERN, FILE_FACTOR = r"\.(pdf|doc|docx|ppt|pptx|zip)$", 0.7
CONCISE_WORDS, CONCISE_POINTS = ("call", "submit", "deadline"), 0.5
YEAR_POINTS = 1.0
DEFAULT_YEAR = 2026


def _points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def link_words(text: Column, title: Column, context: Column) -> Column:
    """The lower-case text in which the words are looked for."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (text, title, context)]))


def link_score(
    url: Column,
    text: Column,
    words: Column,
    custom_words: Column | None = None,
    year: int = DEFAULT_YEAR,
) -> Column:
    """Score of a link from its url, its text and its `link_words`."""
    low_url, text = F.lower(url), F.coalesce(text, F.lit(""))
    terms = [_points(low_url.rlike(p), v) for p, v in URL_POINTS]
    terms += [_points(F.contains(words, F.lit(w)), HIGH_POINTS) for w in HIGH_WORDS]
    terms += [_points(F.contains(words, F.lit(w)), MEDIUM_POINTS) for w in MEDIUM_WORDS]
    if custom_words is not None:
        hits = F.size(F.filter(custom_words, lambda w: F.contains(words, F.lower(w))))
        terms.append(F.coalesce(F.greatest(hits, F.lit(0)), F.lit(0)) * CUSTOM_POINTS)
    score = reduce(lambda a, b: a + b, terms)
    score = score * F.when(F.length(url) > LONG_URL_CHARS, LONG_URL_FACTOR).otherwise(1.0)
    score = score * F.when(low_url.rlike(FILE_PATTERN), FILE_FACTOR).otherwise(1.0)
    has_word = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in CONCISE_WORDS])
    score = score + _points(F.length(text).between(6, 49) & has_word, CONCISE_POINTS)
    score = score + _points(F.contains(url, F.lit(str(year))) | F.contains(words, F.lit(str(year))), YEAR_POINTS)
    return F.round(score, 2)
