"""Fingerprints, the tiered change decision and threshold tuning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import hashing as X
from pagetide.operators.text import filtered_text

THRESHOLD = 5
TUNED = range(1, 21)
PAIR_MASK = 0x0000000100000001
LOW_HALF = 0x00000000FFFFFFFF


def simhash(
    rows: DataFrame,
    keys: list[str],
    text: str,
    token_hash: Callable[[Column], Column] = X.portable_hash64,
    out: str = "simhash",
) -> DataFrame:
    """(keys, simhash): 64-bit SimHash of the word tokens, weighted by frequency.

    A bit is 1 when at least half of the tokens have it; a text without tokens
    has 0.  Two bit counts share one long (32 bits each, more tokens than a
    string can hold), so a document is 32 sums, added up before the shuffle.
    """
    tokens = rows.select(*keys, F.explode_outer(F.array_remove(F.split(F.lower(text), X.TOKEN_BREAK), "")).alias("_token"))
    # Hashed outside of any condition: within one, Spark would take the digest anew for each half of the hash.
    hashed = tokens.select(*keys, "_token", token_hash(F.col("_token")).alias("_h"))
    pairs = [F.expr(f"coalesce(sum(shiftrightunsigned(_h, {k}) & {PAIR_MASK}L), 0L) AS _c{k}") for k in range(32)]
    votes = hashed.groupBy(*keys).agg(F.count("_token").alias("_n"), *pairs)
    low = " | ".join(f"IF((_c{k} & {LOW_HALF}L) * 2 >= _n, {1 << k}L, 0L)" for k in range(32))
    high = " | ".join(f"IF(shiftrightunsigned(_c{k}, 32) * 2 >= _n, {1 << k}L, 0L)" for k in range(32))
    return votes.select(*keys, F.expr(f"IF(_n > 0, shiftleft({high}, 32) | ({low}), 0L)").alias(out))


def fingerprints(pages: DataFrame, key: str = "page_id", html: str = "html", text: str = "filtered_text") -> DataFrame:
    """(key, binary_hash, filtered_hash, simhash) of pages with their text."""
    hashed = pages.select(
        key, text, X.sha256_hex(F.col(html)).alias("binary_hash"), X.sha256_hex(F.col(text)).alias("filtered_hash")
    )
    return simhash(hashed, [key, "binary_hash", "filtered_hash"], text)


def page_fingerprints(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, binary_hash, filtered_hash, simhash) of pages by their html alone.

    The html is hashed where it is read and cleaned where it is read; only its
    hash is joined to the signature of the text, so neither html nor text of a
    page is shuffled, but for pages that are cleaned by element structure.
    """
    hashed = pages.select(key, X.sha256_hex(F.col("html")).alias("binary_hash"))
    texts = filtered_text(pages.select(key, "html"), key)
    signed = simhash(texts.select(key, "filtered_text", X.sha256_hex(F.col("filtered_text")).alias("filtered_hash")), [key, "filtered_hash"], "filtered_text")
    return hashed.join(signed, key).select(key, "binary_hash", "filtered_hash", "simhash")


def decision(
    has_old: Column,
    new: Callable[[str], Column],
    old: Callable[[str], Column],
    threshold: int = THRESHOLD,
    semantic: bool = False,
) -> Column:
    """struct(change_detected, change_type, hamming_distance), cheapest tier first.

    With equal filtered hashes the signatures are equal too, so the third tier
    only ever confirms "no change".  `semantic=True` also puts pages whose
    filtered hash differs to the third tier: a small distance then counts as
    no change, a large one as SEMANTIC.
    """
    distance = X.hamming(new("simhash"), old("simhash"))

    def verdict(changed: bool, kind: str, dist: Column | None = None) -> Column:
        return F.struct(
            F.lit(changed).alias("change_detected"),
            F.lit(kind).alias("change_type"),
            (F.lit(None) if dist is None else dist).cast("int").alias("hamming_distance"),
        )

    chain = F.when(~has_old, verdict(True, "BINARY")).when(
        new("binary_hash") == old("binary_hash"), verdict(False, "NONE")
    )
    if not semantic:
        chain = chain.when(~new("filtered_hash").eqNullSafe(old("filtered_hash")), verdict(True, "FILTERED"))
    return (
        chain.when(old("simhash").isNull(), verdict(True, "BINARY"))
        .when(distance > threshold, verdict(True, "SEMANTIC", distance))
        .otherwise(verdict(False, "NONE", distance))
    )


def detect_changes(new: DataFrame, old: DataFrame, key: str = "page_id", threshold: int = THRESHOLD, semantic: bool = False) -> DataFrame:
    """`new` fingerprints against the last known ones, one row per new page.

    A page that `old` lacks, or whose old binary hash is NULL, has no old
    fingerprints.
    """
    joined = new.alias("n").join(old.alias("o"), key, "left")
    verdict = decision(
        F.col("o.binary_hash").isNotNull(), lambda c: F.col(f"n.{c}"), lambda c: F.col(f"o.{c}"), threshold, semantic
    )
    return joined.select(key, *[f"n.{c}" for c in new.columns if c != key], verdict.alias("_v")).select(
        "*", "_v.*"
    ).drop("_v")


def apply_baseline(is_baseline: Column, n_deadlines: Column, changed: Column, kind: Column) -> tuple[Column, Column]:
    """First scan of a target: a change only if it already shows deadlines."""
    found = n_deadlines > 0
    return (
        F.when(is_baseline, found).otherwise(changed),
        F.when(is_baseline & found, F.lit("BINARY")).when(is_baseline, F.lit("NONE")).otherwise(kind),
    )


def tune_threshold(pairs: DataFrame, label: str = "expected_change", current: int = THRESHOLD, semantic: bool = False) -> DataFrame:
    """One row (threshold, accuracy): the lowest threshold of best accuracy.

    `pairs` holds new_* and old_* fingerprints and a label.  All thresholds are
    counted in one pass over the pairs, as conditional sums.  With no pairs, or
    no pair right at any threshold, `current` stays.
    """
    def new(c: str) -> Column:
        return F.col(f"new_{c}")

    def old(c: str) -> Column:
        return F.col(f"old_{c}")

    # A negative threshold lets through every pair that reaches the third tier.
    free = pairs.select(F.col(label).alias("_y"), decision(old("binary_hash").isNotNull(), new, old, -1, semantic).alias("_d"))

    def right(t: int) -> Column:
        detected = F.when(F.col("_d.change_type") == "SEMANTIC", F.col("_d.hamming_distance") > t).otherwise(F.col("_d.change_detected"))
        return F.count_if(detected == F.col("_y"))

    counted = free.agg(F.count("_y").alias("_n"), F.array(*[F.struct(right(t).alias("hits"), F.lit(-t).alias("t")) for t in TUNED]).alias("_s"))
    best = F.array_max("_s")
    kept = best["hits"] > 0
    return counted.select(
        F.when(kept, -best["t"]).otherwise(F.lit(current)).alias("threshold"),
        F.when(F.col("_n") > 0, best["hits"] / F.col("_n")).otherwise(F.lit(0.0)).alias("accuracy"),
    )
