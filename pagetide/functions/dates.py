"""Deadline wording: exclusion, classification and date parsing by pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.once import once

# Wording of a deadline, most specific first.
TYPE_PATTERNS = (
    ("abstract", r"\b(abstract|extended abstract)\s+(submission|deadline|due)"),
    ("paper", r"\b(paper|full paper|manuscript)\s+(submission|deadline|due)"),
    ("registration", r"\b(registration|early bird|late registration)\s+(deadline|due|closes)"),
    ("camera-ready", r"\b(camera[- ]?ready|final version|final submission)\s+(deadline|due)"),
)

# Sentences whose dates are not deadlines.
EXCLUDE_PATTERNS = (
    r"copyright\s+\d{4}",
    r"©\s*\d{4}",
    r"all rights reserved",
    r"last updated",
    r"page \d+ of \d+",
    r"powered by",
    r"website by",
    r"designed by",
)

WINDOW_DAYS = 730
EXPLICIT_CONFIDENCE = 0.9
RELATIVE_CONFIDENCE = 0.7
BOOST = 0.1

MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")
MONTH_WORD = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY = r"(\d{1,2})(?:st|nd|rd|th)?"

# The second day of a range such as "5-8"; the first one counts.
TO_DAY = r"(?:\s*[-–]\s*\d{1,2}(?:st|nd|rd|th)?)?"

# Year first, a time may follow the day.
ISO = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:t\d{1,2}:\d{2}|\b)"
MONTH_DAY_YEAR = rf"\b{MONTH_WORD}\.?\s+{DAY}{TO_DAY}\s*,?\s+(\d{{4}})\b"
DAY_MONTH_YEAR = rf"\b{DAY}{TO_DAY}(?:\s+(?:of\s+)?|-){MONTH_WORD}\.?,?(?:\s+|-)(\d{{4}})\b"
SLASHED = r"\b(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\b"
MONTH_YEAR = rf"\b{MONTH_WORD}\.?,?\s+(\d{{4}})\b"
MONTH_DAY = rf"\b{MONTH_WORD}\.?\s+{DAY}\b"
DAY_MONTH = rf"\b{DAY}\s+(?:of\s+)?{MONTH_WORD}\b"
# Any of them; where several start at one place the longer form comes first.
ANY_DATE = "|".join((ISO, MONTH_DAY_YEAR, DAY_MONTH_YEAR, SLASHED, MONTH_YEAR, MONTH_DAY, DAY_MONTH))
# Relative dates count only in a sentence that speaks of an end or a hand-in.
DUE_WORDS = r"\b(deadlines?|due|closes?|closing|ends?|expires?|submit|submissions?|submitted|register|registration|last (?:day|chance))\b"
IN_DAYS = r"\bin\s+(\d{1,4})\s+days?\b"
IN_WEEKS = r"\bin\s+(\d{1,3})\s+weeks?\b"


def excluded(sentence: Column) -> Column:
    return F.lower(sentence).rlike("|".join(EXCLUDE_PATTERNS))


def classify(sentence: Column) -> Column:
    lowered = F.lower(sentence)
    (name, pattern), *rest = TYPE_PATTERNS
    chain = F.when(lowered.rlike(pattern), F.lit(name))
    for name, pattern in rest:
        chain = chain.when(lowered.rlike(pattern), F.lit(name))
    return chain.otherwise(F.lit("general"))


def month_number(word: Column) -> Column:
    """1..12 from a month name or its abbreviation, by the first three letters."""
    starts = F.instr(F.lit("|".join(m[:3] for m in MONTHS)), F.lower(F.substring(word, 1, 3)))
    return ((starts + 3) / 4).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where the calendar has no such day."""
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "y-M-d")


def _slashed(lowered: Column) -> Column:
    first, second = (F.regexp_extract(lowered, SLASHED, i) for i in (1, 2))
    written = F.regexp_extract(lowered, SLASHED, 3)
    year = F.when(F.length(written) == 2, F.concat(F.lit("20"), written)).otherwise(written)
    return F.coalesce(_date(year, first, second), _date(year, second, first))


def _month_year(lowered: Column, as_of: Column) -> Column:
    """The as-of day in that month, or the month's last day if it is shorter."""
    first = _date(F.regexp_extract(lowered, MONTH_YEAR, 2), month_number(F.regexp_extract(lowered, MONTH_YEAR, 1)), F.lit(1))
    last = F.last_day(first)
    return F.least(last, F.date_add(first, F.dayofmonth(as_of) - 1))


def with_date(rows: DataFrame, as_of: Column, sentence: str = "sentence") -> DataFrame:
    """Adds `date` and `base`, its confidence; both NULL if the sentence names none.

    At most one date per sentence, the first one written out in it.  Missing
    parts are taken from `as_of`.  The sentence is searched once; the parts are
    then read off the few characters found.
    """
    lowered = once(rows, F.lower(sentence).alias("_low"))
    # every written form has a digit: most sentences are told by that alone
    found = once(lowered, F.when(F.col("_low").rlike("[0-9]"), F.regexp_extract("_low", ANY_DATE, 0)).otherwise(F.lit("")).alias("_found"))
    both = once(found, _explicit(F.col("_found"), as_of).alias("_explicit"), _relative(F.col("_low"), as_of).alias("_relative"))
    base = F.when(F.col("_explicit").isNotNull(), F.lit(EXPLICIT_CONFIDENCE)).when(F.col("_relative").isNotNull(), F.lit(RELATIVE_CONFIDENCE))
    out = both.withColumn("date", F.coalesce("_explicit", "_relative")).withColumn("base", base)
    return out.drop("_low", "_found", "_explicit", "_relative")


def _explicit(low: Column, as_of: Column) -> Column:
    g = F.regexp_extract
    this_year = F.year(as_of)
    return F.when(
        low != "",
        F.when(low.rlike(ISO), _date(g(low, ISO, 1), g(low, ISO, 2), g(low, ISO, 3)))
        .when(low.rlike(MONTH_DAY_YEAR), _date(g(low, MONTH_DAY_YEAR, 3), month_number(g(low, MONTH_DAY_YEAR, 1)), g(low, MONTH_DAY_YEAR, 2)))
        .when(low.rlike(DAY_MONTH_YEAR), _date(g(low, DAY_MONTH_YEAR, 3), month_number(g(low, DAY_MONTH_YEAR, 2)), g(low, DAY_MONTH_YEAR, 1)))
        .when(low.rlike(SLASHED), _slashed(low))
        .when(low.rlike(MONTH_YEAR), _month_year(low, as_of))
        .when(low.rlike(MONTH_DAY), _date(this_year, month_number(g(low, MONTH_DAY, 1)), g(low, MONTH_DAY, 2)))
        .when(low.rlike(DAY_MONTH), _date(this_year, month_number(g(low, DAY_MONTH, 2)), g(low, DAY_MONTH, 1))),
    )


def _relative(low: Column, as_of: Column) -> Column:
    """ "tomorrow", "in 5 days", "in 2 weeks", next to deadline wording."""
    g = F.regexp_extract
    worded = F.contains(low, F.lit("tomorrow")) | F.contains(low, F.lit("day")) | F.contains(low, F.lit("week"))
    return F.when(
        worded & low.rlike(DUE_WORDS),
        F.when(low.rlike(r"\btomorrow\b"), F.date_add(as_of, 1))
        .when(low.rlike(IN_DAYS), F.date_add(as_of, g(low, IN_DAYS, 1).try_cast("int")))
        .when(low.rlike(IN_WEEKS), F.date_add(as_of, g(low, IN_WEEKS, 1).try_cast("int") * 7)),
    )


def boosted(base: Column, is_snippet: Column, sentence: Column) -> Column:
    """Confidence after the snippet and the keyword boost, at most 1."""
    steps = [is_snippet, sentence.rlike(r"(?i)\bdeadline\b")]
    return reduce(lambda c, on: F.when(on, F.least(F.lit(1.0), c + BOOST)).otherwise(c), steps, base)


def in_window(day: Column, first: Column, last: Column) -> Column:
    return day.between(first, last)
