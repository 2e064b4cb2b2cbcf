"""Product quantisation of embeddings in whole numbers, assigned by the pivots of LAESA.

Each part of a vector is compared with a few fixed pivots once; these distances
are kept with the part.  In each round the pivots' distances to the codebook's
entries are computed, and by the triangle inequality the difference of the two
is a lower bound of the distance from part to entry.  Entries are tried in
the order of their bounds, in whole numbers, until no bound is below the best
distance found, so that the assignment is exact.

A round is one pass: tasks add up their parts by entry, Spark adds the tasks up, and
only the codebooks (256 entries for each of 4 parts) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.shared import stored
from pagetide.llm.vectors import finite, matrix, scaled

PARTS, ENTRIES, ROUNDS, PIVOTS, FACTOR = 4, 256, 4, 12, 1024
#: Whole components are held within this, so that sums of squares stay whole in 64 bits up to 2^17 components.
MOST = 1 << 22
#: Rows of a slice: bounds of 256 entries each.
SLICE = 4096


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whole squared distances of rows one by one."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of `x` to all rows of `y` (few)."""
    return np.sqrt(np.stack([((x - row) ** 2).sum(1) for row in y], 1).astype(np.float64)) if len(y) else np.zeros((len(x), 0))


def chosen_pivots(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen, ties to the lower index."""
    chosen = [0]
    gap = squares(entries, entries[:1])
    while len(chosen) < min(most, len(entries)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squares(entries, entries[chosen[-1]][None, :]))
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each part (ties to the lower index), its squared distance, and how many distances were computed."""
    n = len(parts)
    from_pivots = between(entries, pivots)
    bound = np.zeros((n, len(entries)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - from_pivots[None, :, p]), out=bound)
    # a bound is a difference of two roots: it may be too large by their rounding
    bound -= 1e-9 * (1 + np.maximum(to_pivots.max(1, initial=0)[:, None], from_pivots.max(1, initial=0)[None, :]))
    order = np.argsort(bound, axis=1, kind="stable")
    ranked = np.take_along_axis(bound, order, 1)
    best, where, done = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries)), 0
    open_rows = np.arange(n)
    for step in range(len(entries)):
        open_rows = open_rows[ranked[open_rows, step] <= np.sqrt(best[open_rows].astype(np.float64))]
        if not len(open_rows):
            break
        entry = order[open_rows, step]
        gap = squares(parts[open_rows], entries[entry])
        done += len(gap)
        better = (gap < best[open_rows]) | (gap == best[open_rows]) & (entry < where[open_rows])
        best[open_rows[better]], where[open_rows[better]] = gap[better], entry[better]
    return where, best, done


def cut(values: np.ndarray) -> np.ndarray:
    """(part, row, component): whole vectors in equal consecutive parts; the last one is filled up with zeros."""
    width = -(-values.shape[1] // PARTS)
    return np.pad(values, ((0, 0), (0, width * PARTS - values.shape[1]))).reshape(len(values), PARTS, width).transpose(1, 0, 2)


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivots: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(0, batch.num_rows, SLICE):
        rows = batch.slice(k, SLICE)
        parts = cut(matrix(rows.column("whole"), np.int64))
        kept = matrix(rows.column("to_pivots"))
        at = 0
        for p in range(PARTS):
            own = kept[:, at:at + len(pivots[p])]
            at += len(pivots[p])
            where, gap, _ = nearest(parts[p], own, books[p], pivots[p])
            yield rows, p, parts[p], where, gap


def with_pivot_distances(whole: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """id, label, whole and to_pivots (part after part), which are computed here once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(0, batch.num_rows, SLICE):
                rows = batch.slice(k, SLICE)
                cuts = cut(matrix(rows.column("whole"), np.int64))
                gaps = np.concatenate([between(cuts[p], pivots[p]) for p in range(PARTS)], 1)
                lists = pa.ListArray.from_arrays(np.arange(0, gaps.size + 1, gaps.shape[1], dtype=np.int32), gaps.ravel())
                yield pa.record_batch([*rows.columns, lists], names=[*rows.schema.names, "to_pivots"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    return whole.mapInArrow(run, f"{kinds}, to_pivots array<double>")


def sums_by_entry(held: DataFrame, books: np.ndarray, pivots: list[np.ndarray]) -> DataFrame:
    """part, entry, n and one sum per component, from every task once."""
    width = books[0].shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((PARTS, len(books[0]), width), np.int64)
        for batch in parts:
            for _, p, values, where, _ in _assigned(batch, books, pivots):
                count[p] += np.bincount(where, minlength=len(count[p]))
                np.add.at(total[p], where, values)
        at, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(0, len(at) * width + 1, width, dtype=np.int32), total[at, entry].ravel())
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[at, entry]), sums], names=["part", "entry", "n", "sums"])

    added = held.select("whole", "to_pivots").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"sum{k}") for k in range(width)))


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def whole_rows(rows: DataFrame, id_col: str, vec_col: str, label_col: str, factor: int) -> DataFrame:
    """id, label and whole (components) of the rows with a finite vector of one component at least."""
    vec = F.col(vec_col).cast("array<double>")
    return rows.filter(finite(vec) & (F.size(vec) > 0)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(vec, factor, MOST).alias("whole"))


def pivot_codes(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", factor: int = FACTOR) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every row with a finite vector.

    Rows with a null or empty vector, or a null or non-finite component, are dropped.  All vectors must have the length of
    the one with the smallest id; rows of another length are dropped too.  Where that length is no multiple of four,
    the last part is filled up with zeros.  The first codebooks are the vectors of the 256 smallest ids (all, if fewer;
    repeated ids in the order of their vectors; rows without an id, which come out with a null one, only after all others).
    Whole components are held within 2^22.  Repeated rows count and come out each.  An empty table gives an empty result.
    label_error adds up the errors of all rows of the label, null being one; other columns are not read.
    """
    taken = whole_rows(rows, id_col, vec_col, label_col, factor)
    kind = rows.schema[id_col].dataType.simpleString()
    first = [r["whole"] for r in taken.orderBy(F.col("id").asc_nulls_last(), "whole").limit(ENTRIES).select("whole").collect()]
    first = [x for x in first if len(x) == len(first[0])]
    if not first:
        return taken.limit(0).select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    books = cut(np.array(first, np.int64))
    pivots = [chosen_pivots(book) for book in books]
    held = stored(with_pivot_distances(taken.filter(F.size("whole") == len(first[0])), pivots), "pivot-distances")
    for _ in range(ROUNDS):
        books = books.copy()
        for r in sums_by_entry(held, books, pivots).collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r[3:]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            done = list(_assigned(batch, books, pivots))
            for k in range(0, len(done), PARTS):
                some = done[k][0]
                code = np.stack([where for _, _, _, where, _ in done[k:k + PARTS]], 1).astype(np.uint8)
                error = np.sum([gap for _, _, _, _, gap in done[k:k + PARTS]], 0)
                yield pa.record_batch([some.column("id"), some.column("label"), pa.array([x.tobytes().hex() for x in code]), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    label = rows.schema[label_col].dataType.simpleString()
    coded = stored(held.mapInArrow(run, f"id {kind}, label {label}, code string, error long"), "pivot-codes")
    total = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(total, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
