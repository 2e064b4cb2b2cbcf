"""Benchmark decontamination: size-partitioned MinHash search for short items in long documents.

A document contains an item if it holds at least `share` of the item's distinct
word shingles.  Items are partitioned by size, and each keeps as its sketch
the smallest n - ceil(share * n) + 1 hashes of its n shingles: a document that
contains the item misses fewer shingles than the sketch has, so it holds one
of them.  No item is lost, however long the document is.  A document
shows only the hashes up to the largest sketch value among items it is large
enough to contain.  What the search finds is verified on the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.once import once
from pagetide.llm.shared import stored
from pagetide.llm.shingles import shingle_hashes, shingles


def item_sketches(items: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """item, least (shingles a document must hold), hash: the sketch of every item, a row per value."""
    hashes = items.select(F.col(id_col).alias("item"), F.sort_array(shingle_hashes(F.col(text_col))).alias("hashes"))
    n = F.size("hashes")
    least = F.ceil(n * percent / 100).cast("int")
    return hashes.filter(n > 0).select("item", least.alias("least"), F.explode(F.slice("hashes", F.lit(1), n - least + 1)).alias("hash"))


def candidates(docs: DataFrame, items: DataFrame, percent: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """Pairs (doc, item) that share a sketch value and whose sizes fit, each once."""
    sketches = item_sketches(items, percent, item_col, item_text)
    level = F.floor(F.log2("least")).cast("int")
    bounds = sketches.groupBy(level.alias("level")).agg(F.max("hash").alias("top"), F.min("least").alias("least")).orderBy("level").collect()
    shown: Column = F.lit(-(1 << 63))
    highest = None
    for row in bounds:  # one row per power of two of item sizes
        highest = row["top"] if highest is None else max(highest, row["top"])
        shown = F.when(F.size("hashes") >= row["least"], F.lit(highest)).otherwise(shown)
    hashed = once(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")), shingle_hashes(F.col("_text")).alias("hashes"))
    limited = once(hashed.select("doc", "hashes"), shown.alias("top"), F.size("hashes").alias("n"))
    probes = limited.select("doc", "n", F.explode(F.filter("hashes", lambda h: h <= F.col("top"))).alias("hash"))
    return probes.join(sketches, "hash").filter("n >= least").select("doc", "item").distinct()


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Items that documents contain: id, item id, n_shingles (of the item), n_found (of them in the document), containment.

    A row per pair with 100 * n_found >= `percent` * n_shingles.  Words are
    lower-cased; an item of fewer than five words is one shingle, found
    only in a text of the same words.  Null or empty texts and null ids take
    part in no pair.  Rows with a repeated id count as one document or item with
    the shingles of all.  More columns are ignored.
    """
    docs = docs.select(id_col, text_col).filter(F.col(id_col).isNotNull())
    items = items.select(item_col, item_text).filter(F.col(item_col).isNotNull())
    found = stored(candidates(docs, items, percent, id_col, text_col, item_col, item_text), "candidates")
    ids = found.select("doc").distinct()
    held = docs.join(ids, F.col(id_col) == F.col("doc"), "left_semi").select(F.col(id_col).alias("doc"), F.explode(shingles(F.col(text_col))).alias("shingle"))
    wanted = items.select(F.col(item_col).alias("item"), F.explode(shingles(F.col(item_text))).alias("shingle")).distinct()
    sizes = wanted.groupBy("item").agg(F.count("*").alias("n_shingles"))
    counts = held.join(wanted, "shingle").distinct().join(found, ["doc", "item"], "left_semi").groupBy("doc", "item").agg(F.count("*").alias("n_found"))
    kept = counts.join(sizes, "item").filter(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
    return kept.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
