"""Registered queries of the operators in this folder, with their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.bpe import bpe_round_trip
from pagetide.llm.cap_filters import near_vectors
from pagetide.llm.decontamination import contained_items
from pagetide.llm.hard_negatives import hard_negatives
from pagetide.llm.html_extract import extract_main_text
from pagetide.llm.license_scan import known_digests, license_scan
from pagetide.llm.lm_scoring import score_texts
from pagetide.llm.near_dedup import near_duplicates
from pagetide.llm.pivot_codes import pivot_codes
from pagetide.llm.quality_classifier import fit_quality, quality_scores
from pagetide.llm.quality_rules import quality_rules
from pagetide.llm.shared import fold_of, table
from pagetide.llm.sql import DECONTAMINATION, license_sql
from pagetide.llm.suffix_dedup import remove_repeats
from pagetide.llm.token_counts import token_counts
from pagetide.llm.vector_sql import HARD_NEGATIVES, NEAR_VECTORS, pivot_codes_sql

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"), known_digests(spark))
    return found.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=fold_of(F.col("doc_id")) != 0)
    return quality_scores(docs.select("doc_id", "text"), model).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of(F.col("doc_id")) == 1
    scores = score_texts(table(spark, sf_dir, "documents"), learn=~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), RANKS)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_classifier, op3_decontamination, op4_token_counts, op5_lm_scoring, op6_html_extraction, op7_quality_rules, op8_minhash_near_dedup,
    op9_suffix_dedup, op10_byte_bpe, op11_hard_negatives, op12_embedding_near_dedup, op13_vector_codes,
)}
SQL: dict[str, str] = {
    "op1_license_scan": license_sql(), "op3_decontamination": DECONTAMINATION,
    "op11_hard_negatives": HARD_NEGATIVES, "op12_embedding_near_dedup": NEAR_VECTORS, "op13_vector_codes": pivot_codes_sql(),
}
