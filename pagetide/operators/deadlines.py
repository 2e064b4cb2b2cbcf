"""Deadlines from sentences: exclude, parse, check, classify, score, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import dates as D
from pagetide.functions import html as H

SENTENCE_BREAK = r"[.!?\n]+"
SOURCE_CHARS = 200


def split_sources(
    pages: DataFrame, key: str, snippets: str = "snippets", main: str = "main_text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(key, seq, is_snippet, sentence): snippet sentences first, then the main text.

    `seq` orders the sentences of a page as they are processed.
    """
    def cut(text: Column, number: Column, is_snippet: Column) -> Column:
        return F.transform(
            H.sentences(text, SENTENCE_BREAK),
            lambda s, i: F.struct(number.alias("part"), i.alias("i"), is_snippet.alias("is_snippet"), s.alias("sentence")),
        )

    none = F.array().cast("array<string>")
    from_snippets = F.flatten(F.transform(F.coalesce(F.col(snippets), none), lambda s, n: cut(s, n, F.lit(True))))
    from_main = cut(F.coalesce(F.col(main), F.lit("")), F.lit(2**31 - 1), F.lit(False))
    return pages.select(key, *carry, F.inline(F.concat(from_snippets, from_main))).select(
        key, *carry, F.struct("part", "i").alias("seq"), "is_snippet", "sentence"
    )


def candidate_deadlines(
    sentences: DataFrame, as_of: Column, first: Column | None = None, last: Column | None = None
) -> DataFrame:
    """Adds date, type, confidence and source_text; rows without a valid date drop out."""
    first = F.to_date(as_of) if first is None else first
    last = F.date_add(as_of, D.WINDOW_DAYS) if last is None else last
    kept = sentences.filter(~D.excluded(F.col("sentence")))
    dated = D.with_date(kept, as_of).filter(D.in_window(F.col("date"), first, last))
    return (
        dated.withColumn("type", D.classify(F.col("sentence")))
        .withColumn("confidence", F.round(D.boosted(F.col("base"), F.col("is_snippet"), F.col("sentence")), 4))
        .withColumn("source_text", F.substring("sentence", 1, SOURCE_CHARS))
        .drop("base")
    )


def dedup_deadlines(candidates: DataFrame, key: str) -> DataFrame:
    """Per page, date and type the most confident one, the first seen on ties.

    Written as an aggregate so that repeats are dropped before the shuffle.
    """
    best = F.min_by(
        F.struct("confidence", "source_text", "seq"), F.struct((-F.col("confidence")).alias("c"), F.col("seq"))
    )
    return candidates.groupBy(key, "date", "type").agg(best.alias("_b")).select(key, "date", "type", "_b.*")


def deadline_lists(deduped: DataFrame, key: str) -> DataFrame:
    """(key, deadlines): the page's deadlines by date, as one sorted array."""
    ordered = F.array_sort(F.collect_list(F.struct("date", "seq", "type", "confidence", "source_text")))
    slim = F.transform(ordered, lambda d: F.struct(d["date"].alias("date"), d["type"].alias("type"), d["confidence"].alias("confidence"), d["source_text"].alias("source_text")))
    return deduped.groupBy(key).agg(slim.alias("deadlines"))


def extract_deadlines(pages: DataFrame, key: str, as_of: Column, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(key, deadlines) of the pages that show any, from `snippets` and `main_text`."""
    dated = pages.withColumn("_as_of", F.to_date(as_of))
    found = candidate_deadlines(split_sources(dated, key, carry=("_as_of",)), F.col("_as_of"), first, last)
    return deadline_lists(dedup_deadlines(found, key), key)
