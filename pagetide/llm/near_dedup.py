"""Near duplicates by bottom-k sketches of word shingles from one hash function.

A document's sketch is its smallest `K` shingle hashes.  Documents with equal
sets are one class from the start.  Inverted lists of retained values show
which classes may be close; a union-sketch estimate filters them and the
Jaccard similarity of the full sets decides.

Which values are listed: two sets of similarity 0.75 share at least `OVERLAP` of
their sketches' values (the chance of fewer is below 1e-8), so they share one
among the K - OVERLAP + 1 rarest of each.  Values that no other document
retains come first and need no list, so a document lists a common
passage only if most of its sketch is shared.

How lists become links without all their pairs: each list first links its
members to one leader, the one whose sketch is shared most, which stands in the
middle of a group of near copies.  Lists that the leaders leave in several
components form clusters; a cluster's members are compared in blocks, by
products of their set matrices, and only links leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.graph import components
from pagetide.llm.shared import batches, stored
from pagetide.llm.word_hashes import shingle_sets

K = 64
OVERLAP = 28
#: Members of a cluster compared with as many others in one go, and hashes in a matrix.
BLOCK, SLICE = 512, 4096


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n (set size), digest (of the whole set), sketch (its smallest K hashes) of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, text_col, 2 << 20):
            sets = shingle_sets([t.as_py() or b"" for t in pc.cast(batch.column(text_col), pa.binary())])
            yield pa.record_batch([
                batch.column(id_col), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], names=["doc", "n", "digest", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc {kind}, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and `shingles` (all sorted hashes, packed)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, text_col, 2 << 20):
            sets = shingle_sets([t.as_py() or b"" for t in pc.cast(batch.column(text_col), pa.binary())])
            yield pa.record_batch([batch.column(id_col), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc {kind}, shingles binary")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """value, doc, n, weight (how often its sketch's values are retained): the lists of classes.  `reps` has doc, n, sketch."""
    rows = reps.select("doc", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = rows.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    per_doc = rows.join(shared, "value").groupBy("doc", "n", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    overlap = F.ceil(F.col("kept") * OVERLAP / K).cast("int")
    places = F.size("shared") - overlap + 1  # the values that nobody shares took the first places
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    listed = per_doc.filter(places > 0).select("doc", "n", weight.alias("weight"), F.explode(F.slice("shared", F.lit(1), places)).alias("x"))
    return listed.select(F.col("x.value").alias("value"), "doc", "n", "weight")


def fitting(percent: int) -> str:
    """Sizes of x and y allow the similarity."""
    return f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {percent}"


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar; `sets` has doc and shingles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                # estimate: how many of the K smallest of the union both have
                union = np.sort(np.concatenate([s[:K], t[:K]]))
                twice = union[1:][union[1:] == union[:-1]]
                union = np.unique(union)[:K]
                if len(union) and np.searchsorted(twice, union[-1], "right") * K < OVERLAP * len(union):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both * 100 >= percent * (len(s) + len(t) - both):
                    kept.append(i)
            yield pa.record_batch([pa.array([a[i] for i in kept], batch.column("a").type), pa.array([b[i] for i in kept], batch.column("b").type)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of `left` shares with each of `right`, by matrix products over slices of the common hashes."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    sides = []
    for values, rows in ((a, row_a), (b, row_b)):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], rows[hit][order]))
    for low in range(0, len(common), SLICE):
        part = []
        for (at, rows), n in zip(sides, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(at, [low, low + SLICE])
            m = np.zeros((n, min(SLICE, len(common) - low)), np.float32)
            m[rows[i:j], at[i:j] - low] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def links_across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a cluster that are in different components; `rest` has value, doc, component.

    A cluster is what lists connect.  Its members are dealt into blocks of about `BLOCK`;
    a task compares two blocks, or several clusters of one block each.
    """
    spark = rest.sparkSession
    first = rest.groupBy("value").agg(F.min("doc").alias("a"))
    cluster = components(rest.join(first, "value").select("a", F.col("doc").alias("b"))).withColumnsRenamed({"node": "doc", "component": "cluster"})
    members = rest.select("doc", "component").distinct().join(cluster, "doc")
    blocks = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "cluster").join(sets, "doc").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    packs = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pack = F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(packs)))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        pack.alias("pack"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cluster", "doc", "component", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cluster", "ascending"), ("doc", "ascending")])
        cluster, doc, component = (group[c].to_numpy() for c in ("cluster", "doc", "component"))
        found = [np.frombuffer(x.as_py(), np.uint64) for x in group["shingles"]]
        own, low, high = group["own"].to_numpy(), group["low"][0].as_py(), group["high"][0].as_py()
        first = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
        a, b = [], []
        for begin, end in zip(first, [*first[1:], len(cluster)], strict=True):
            rows = np.arange(begin, end)
            left, right = rows[own[rows] == low], rows[own[rows] == high]
            if not len(left) or not len(right):
                continue
            both = shared_counts([found[i] for i in left], [found[i] for i in right]).astype(np.int64)
            size = np.array([len(s) for s in found], np.int64)
            near = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            near &= component[left][:, None] != component[right][None, :]
            i, j = np.nonzero(near)
            a.append(doc[left[i]])
            b.append(doc[right[j]])
        kind = group["doc"].type
        empty = np.zeros(0, doc.dtype)
        return pa.table({"a": pa.array(np.concatenate([empty, *a]), kind), "b": pa.array(np.concatenate([empty, *b]), kind)})

    kind = rest.schema["doc"].dataType.simpleString()
    return paired.groupBy("pack", "low", "high").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by 100 * shared >= `percent` * all distinct five-word shingles.

    Returns one row per distinct id: id, n_shingles, component (smallest id
    reachable), kept (whether the id is its component).  Texts without words,
    null ones too, have no shingles and are linked with nothing.  A null id has
    a null component and is kept.  An id with several texts counts with the
    largest set.  Ids must be whole numbers.  More columns are ignored.
    """
    docs = docs.select(id_col, text_col)
    found = stored(sketches(docs, id_col, text_col), "sketches")
    classes = stored(found.filter("n > 0 AND doc IS NOT NULL").groupBy("n", "digest").agg(F.min("doc").alias("rep")), "classes")
    reps = found.join(classes.select(F.col("rep").alias("doc"), "n", "digest"), ["doc", "n", "digest"], "left_semi").dropDuplicates(["doc", "n", "digest"])
    lists = stored(inverted_lists(reps), "lists")
    listed = docs.join(lists.select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi")
    sets = stored(full_sets(listed, id_col, text_col).groupBy("doc").agg(F.max("shingles").alias("shingles")), "sets")

    leader = lists.groupBy("value").agg(F.max_by(F.struct("doc", "n"), F.struct(F.col("weight"), -F.col("doc"))).alias("x")).select("value", "x.doc", "x.n")
    star = (
        lists.alias("y").join(leader.alias("x"), "value").filter("x.doc <> y.doc").filter(fitting(percent))
        .select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    )
    linked = stored(links(star, sets, percent), "links")
    label = components(linked)

    labelled = lists.join(label, lists["doc"] == label["node"], "left").select("value", "doc", "n", F.coalesce("component", "doc").alias("component"))
    mixed = labelled.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("value")
    rest = stored(labelled.join(mixed, "value", "left_semi").select("value", "doc", "component"), "rest")
    more = stored(links_across(rest, sets, percent), "links")
    if not more.isEmpty():
        label = components(linked.unionByName(more))

    of_class = classes.join(label, classes["rep"] == label["node"], "left").select("n", "digest", F.coalesce("component", "rep").alias("component"))
    rows = found.select("doc", "n", "digest").join(of_class, ["n", "digest"], "left")
    one = rows.groupBy("doc").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component"))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return one.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))
