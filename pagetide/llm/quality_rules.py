"""Quality rules and a likelihood ratio of hashed n-grams between trusted and raw text.

Words and pairs of neighbours are hashed to a fixed number of buckets.  A
multinomial over buckets is counted for the raw corpus (all documents) and one
for trusted documents; a document's score is the mean log ratio of its n-grams.
Every document is held against one threshold, the score that all but a small
share of the trusted documents reach.  Weights are whole numbers, so sums do
not hang on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.once import let, once
from pagetide.llm.shared import BLANKS, stored, words

BUCKETS = 1 << 14
#: Of the trusted documents, one in so many may fall below the threshold.
LOSS = 500
#: Whole-number weights are log ratios times this.
SCALE = 1 << 20
WINDOW = 8


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbours, from word hashes."""
    pairs = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets))), pairs)


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that stand twice or more in the text, from word hashes."""

    def in_windows(windows: Column) -> Column:
        def covered(ordered: Column) -> Column:
            def same(j: Column, x: Column) -> Column:
                return F.get(ordered, j)["h"] == x["h"]

            again = F.filter(ordered, lambda x, j: F.coalesce(same(j - 1, x), F.lit(False)) | F.coalesce(same(j + 1, x), F.lit(False)))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                starts, none,
                lambda s, i: F.struct((i + width).alias("end"), (s["n"] + (i + width - F.greatest(i, s["end"]))).cast("long").alias("n")),
                lambda s: s["n"])

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, covered)).otherwise(F.lit(0).cast("long"))

    last = F.size(hashes) - width
    windows = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(width))))
    return F.when(last > 0, let(windows, in_windows)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and `buckets` of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = once(docs.select(F.col(id_col), text.alias("_text")), F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_hashes"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.regexp_replace(x, BLANKS, "") != "")
    return hashed.select(
        id_col, F.size("_hashes").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_hashes")).alias("n_repeat_words"), F.col("_hashes").alias("hashes"),
    )


def bucket_counts(docs: DataFrame, buckets: int, text_col: str = "text") -> dict[int, int]:
    """n-grams per bucket over all rows; at most `buckets` rows come to the driver."""
    hashed = once(docs.select(F.col(text_col).alias("_text")), F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_hashes"))
    grams = hashed.select(F.explode(ngram_buckets(F.col("_hashes"), buckets)).alias("bucket"))
    return {row["bucket"]: row["count"] for row in grams.groupBy("bucket").count().collect()}


def log_ratios(raw: dict[int, int], trusted: dict[int, int], buckets: int) -> list[int]:
    """Scaled log of trusted over raw share by bucket, counts smoothed by one."""
    n_raw, n_trusted = sum(raw.values()) + buckets, sum(trusted.values()) + buckets
    return [round(SCALE * math.log((trusted.get(b, 0) + 1) / n_trusted * n_raw / (raw.get(b, 0) + 1))) for b in range(buckets)]


def mean_ratio(hashes: Column, weights: list[int]) -> Column:
    """Mean log ratio of a text's n-grams, rounded to a millionth; 0 without words."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    total = let(table, lambda t: F.aggregate(
        ngram_buckets(hashes, len(weights)), F.lit(0).cast("long"), lambda s, b: s + F.get(t, b.cast("int"))))
    return F.when(F.size(hashes) > 0, F.round(total / (2 * F.size(hashes)) / SCALE, 6)).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, loss: int = LOSS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules and verdict of every whole text.

    `trusted_ids` lists trusted documents in a column of the same name as
    `id_col`; all of them give the target multinomial and the threshold.  Their
    texts are joined by id once, for the multinomial; the threshold comes from
    the scored rows, which hold no texts.  The raw multinomial counts all
    documents.

    Returns one row per input row: id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), llr (double), base_failed, kept.  Null and empty
    texts have zeros, fail the base rules and are not kept.  Without trusted
    documents the base rules alone decide.  Null ids are judged like others
    and are never trusted.  More columns are ignored.
    """
    docs = docs.select(id_col, text_col)
    # the ids of a partition are hashed and the texts streamed past them, unsorted; the same plan at every size
    chosen = trusted_ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct().hint("shuffle_hash")
    rows = measured(docs, id_col, text_col)
    target = bucket_counts(docs.join(chosen, id_col, "left_semi"), buckets, text_col)
    ratio = mean_ratio(F.col("hashes"), log_ratios(bucket_counts(docs, buckets, text_col), target, buckets)) if target else F.lit(0.0)
    scored = rows.withColumn("llr", ratio).drop("hashes")
    least = None
    if target:
        scored = stored(scored, "rules")
        # thousandths of the trusted scores: a bounded table, and an exact quantile of it
        trusted = scored.select(id_col, F.floor(F.col("llr") * 1000).alias("_bin")).join(chosen, id_col, "left_semi")
        found = trusted.groupBy("_bin").count().orderBy("_bin").collect()
        spare = sum(r["count"] for r in found) // loss
        for r in found:
            least = r["_bin"] / 1000
            if spare < r["count"]:
                break
            spare -= r["count"]
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    kept = ~failed if least is None else ~failed & (F.col("llr") >= least)
    return scored.withColumn("base_failed", failed).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", kept.alias("kept"))
