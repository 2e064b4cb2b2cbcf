"""From raw documents to training tokens: five stages, each a table for the next.

quality filter, near-duplicate removal, removal of repeated passages, benchmark
decontamination, byte-level pair encoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.bpe import bpe_round_trip
from pagetide.llm.decontamination import contained_items
from pagetide.llm.near_dedup import near_duplicates
from pagetide.llm.quality_classifier import fit_quality, quality_scores
from pagetide.llm.shared import fold_of, stored, table
from pagetide.llm.suffix_dedup import remove_repeats


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside fold 0.  Rows with a null id are judged too."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=fold_of(F.col("doc_id")) != 0)
    return quality_scores(docs, model).filter("predicted = 1").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies.

    Rows of one id stay or go together; rows with a null id stay.
    """
    gone = stored(near_duplicates(docs).filter("NOT kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that a document of a smaller id has too; n_chars counts what is left.

    Every document stays, one that is left with no text as well; null texts stay null.
    """
    left = remove_repeats(docs, as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return left.withColumns({"text": text, "n_chars": F.char_length(text).cast("long")}).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows with a null id stay."""
    leaks = stored(contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), and digests of the ids and of what they decode to."""
    both = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: The classifier is fitted, which SQL does not express; tests/llm hold the operators, not the stages by themselves, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder, which the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
