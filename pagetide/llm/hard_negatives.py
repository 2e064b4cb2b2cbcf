"""Hard negatives by rotated one-bit codes with stored alignment.

A code keeps the signs of a rotated vector.  With its alignment, the inner product a of the
unit vector o and the unit code vector c, o = a c + r where r is at right angles to c
and has the length sqrt(1 - a^2).  So <q, o> = a <q, c> + <q, r>, and by Cauchy and Schwarz
|<q, r>| <= sqrt((|q|^2 - <q, c>^2) (1 - a^2)): an interval that always holds the score.
<q, c> is estimated by popcounts of the code with the bit planes of the
anchor, which is rounded to `QUERY_BITS` bits; the rounding's own bound widens the interval.

The residual r has a code in a rotation of its own, and so on for `LEVELS` levels; each
level narrows the interval of what the one before has left.  Rows whose interval cannot reach an
anchor's current fifth-best score, or its window of negatives, are dropped;
the others are scored in whole numbers.

Anchors are a stated query set against all rows: blocks of at most about `ANCHORS` are sent to the tasks, and
each pass reads all rows once, keeps the best few per anchor in a task, and shuffles only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.shared import stored
from pagetide.llm.vectors import finite, matrix, of_one_length, rotation, scaled

LEVELS, QUERY_BITS = 4, 8
#: Anchors of a pass; anchors and rows whose intervals are computed in one go.
ANCHORS, TILE, SLICE = 8192, 128, 2048
#: Whole components are held within this: a score of 2^12 components stays whole in doubles.
MOST = 1 << 20


def coded(vectors: np.ndarray, levels: int = LEVELS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (level, row, 64-bit word), coefficients (level, row: alignment times the length of what is coded), lengths of what each level leaves."""
    n, dims = vectors.shape
    left = vectors.astype(np.float64)
    words = -(-dims // 64)
    codes, factors, rests = np.zeros((levels, n, words), np.uint64), np.zeros((levels, n)), np.zeros((levels, n))
    for level in range(levels):
        turn = rotation(dims, seed, level)
        turned = left @ turn
        bits = turned >= 0
        factors[level] = np.abs(turned).sum(1) / np.sqrt(dims)
        left = left - (np.where(bits, 1.0, -1.0) @ turn.T) * (factors[level] / np.sqrt(dims))[:, None]
        rests[level] = np.linalg.norm(left, axis=1)
        packed = np.packbits(np.pad(bits, ((0, 0), (0, words * 64 - dims))), axis=1, bitorder="little")
        codes[level] = np.ascontiguousarray(packed).view(np.uint64)
    return codes, factors, rests


class Queries:
    """Anchors as bit planes, for every level: rounded components are low + step * (0 to 2^bits - 1)."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS, seed: int = 11) -> None:
        n, self.dims = vectors.shape
        words = -(-self.dims // 64)
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.planes = np.zeros((levels, QUERY_BITS, n, words), np.uint64)
        self.low, self.step, self.total, self.slack = (np.zeros((levels, n)) for _ in range(4))
        for level in range(levels):
            turned = vectors @ rotation(self.dims, seed, level)
            low = turned.min(1)
            step = np.maximum((turned.max(1) - low) / (2 ** QUERY_BITS - 1), 1e-12)
            number = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 2 ** QUERY_BITS - 1).astype(np.int64)
            self.low[level], self.step[level], self.total[level] = low, step, number.sum(1)
            self.slack[level] = np.abs(turned - low[:, None] - step[:, None] * number).sum(1) / np.sqrt(self.dims)
            for b in range(QUERY_BITS):
                packed = np.packbits(np.pad((number >> b) & 1, ((0, 0), (0, words * 64 - self.dims))).astype(np.uint8), axis=1, bitorder="little")
                self.planes[level, b] = np.ascontiguousarray(packed).view(np.uint64)

    def products(self, level: int, some: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Estimated inner products of pairs (anchor, row): anchors `some` with unit code vectors `codes` (`bits` set in each)."""
        met = np.zeros(len(some))
        for b in range(QUERY_BITS):
            met += np.bitwise_count(self.planes[level, b][some] & codes).sum(-1, dtype=np.int64) * float(1 << b)
        # the sum of a component's sign times low + step * number
        signed = self.low[level][some] * (2.0 * bits - self.dims) + self.step[level][some] * (2.0 * met - self.total[level][some])
        return signed / np.sqrt(self.dims)


class Rows:
    """Rows with their codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.codes, self.factors, self.rests = coded(vectors)
        self.bits = np.bitwise_count(self.codes).sum(2, dtype=np.int64)
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)


def intervals(queries: Queries, rows: Rows, i: np.ndarray, j: np.ndarray, level: int, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of pairs (anchor i, row j) after so many levels, and their new centre; `centre` is that of the level before."""
    product = queries.products(level, i, rows.codes[level, j], rows.bits[level, j])
    slack = queries.slack[level, i]
    centre = centre + rows.factors[level, j] * product
    # what is left stands at right angles to this level's code vector
    along = np.maximum(np.abs(product) - slack, 0)
    across = np.sqrt(np.maximum(queries.norms[i] ** 2 - along ** 2, 0))
    rounding = (rows.factors[:level + 1, j] * queries.slack[:level + 1, i]).sum(0)
    half = (rows.rests[level, j] * across + rounding) * (1 + 1e-9) + 1e-9 * (1 + queries.norms[i] * rows.norms[j])
    return centre - half, centre + half, centre


def _best(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Which entries are among the first `keep` of their anchor and slot, by score and id."""
    order = np.lexsort((ids, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < keep]


class Best:
    """The best entries per anchor and slot so far, and the score that a new one must reach."""

    def __init__(self, anchors: int, slots: int, keep: int) -> None:
        self.shape, self.keep = (anchors, slots), keep
        self.held = [np.zeros(0, np.int64)] * 4
        self.least = np.full(self.shape, np.iinfo(np.int64).min)

    def add(self, *entries: np.ndarray) -> None:
        anchor, slot, score, ids = (np.concatenate([a, b]) for a, b in zip(self.held, entries, strict=True))
        at = _best(anchor, slot, score, ids, self.keep)
        self.held = [anchor[at], slot[at], score[at], ids[at]]
        number = self.held[0] * self.shape[1] + self.held[1]
        full = np.bincount(number, minlength=self.least.size) >= self.keep
        least = np.full(self.least.size, np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.held[2])
        self.least = np.where(full, least, np.iinfo(np.int64).min).reshape(self.shape)


def scan(queries: Queries, anchors: dict, rows: Rows, best: Best, windows: np.ndarray | None, counts: list[int], levels: int = LEVELS) -> None:
    """Adds to `best` what these rows hold for the anchors.

    Without windows: rows of the anchor's label.  With windows (anchor, slot: lowest and highest score, lowest
    above highest in an unused slot): rows of other labels, for each slot whose window holds the score.
    counts: pairs, and pairs scored in whole numbers.
    """
    for a in range(0, len(anchors["id"]), TILE):
        tile = np.arange(a, min(a + TILE, len(anchors["id"])))
        same = anchors["label"][tile][:, None] == rows.labels[None, :]
        if windows is None:
            i, j = np.nonzero(same & (anchors["id"][tile][:, None] != rows.ids[None, :]))
        else:
            i, j = np.nonzero(~same & (windows[tile, :, 0] <= windows[tile, :, 1]).any(1)[:, None])
        i = tile[i]
        counts[0] += len(i)
        centre = np.zeros(len(i))
        for level in range(levels):
            if not len(i):
                break
            low, high, centre = intervals(queries, rows, i, j, level, centre)
            if windows is None:
                reach = best.least[i, 0].astype(np.float64)
                # the fifth-largest lower bound of these rows is a score that `keep` rows reach
                at = _best(i, np.zeros(len(i), np.int64), low, j, best.keep)
                number, many = np.unique(i[at], return_counts=True)
                bar = np.full(len(queries.norms), -np.inf)
                bar[number[many >= best.keep]] = np.inf
                np.minimum.at(bar, i[at], low[at])
                keep = high >= np.maximum(reach, bar[i])
            else:
                floor = np.maximum(windows[i, :, 0].astype(np.float64), best.least[i])
                keep = ((high[:, None] >= floor) & (low[:, None] <= windows[i, :, 1])).any(1)
            i, j, centre = i[keep], j[keep], centre[keep]
        counts[1] += len(i)
        if not len(i):
            continue
        score = np.einsum("ij,ij->i", anchors["whole"][i], rows.vectors[j])
        if windows is None:
            best.add(i, np.zeros(len(i), np.int64), score, rows.ids[j])
        else:
            inside = (score[:, None] >= windows[i, :, 0]) & (score[:, None] <= windows[i, :, 1])
            pair, slot = np.nonzero(inside)
            best.add(i[pair], slot, score[pair], rows.ids[j[pair]])


def _pass(whole: DataFrame, anchors: dict, windows: np.ndarray | None, slots: int, keep: int) -> DataFrame:
    """anchor (its number), slot, score and id: the best entries of every task."""
    dims = anchors["whole"].shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(anchors["whole"])
        best, counts = Best(len(anchors["id"]), slots, keep), [0, 0]
        for batch in parts:
            for at in of_one_length(batch.column("whole")):
                of_length = batch.take(pa.array(at))
                for k in range(0, len(at), SLICE):
                    some = of_length.slice(k, SLICE)
                    vectors = matrix(some.column("whole"), np.int64)
                    if vectors.shape[1] == dims:
                        rows = Rows(some.column("id").to_numpy(), some.column("label").to_numpy(), vectors)
                        scan(queries, anchors, rows, best, windows, counts)
        yield pa.record_batch([pa.array(x, pa.int64()) for x in best.held], names=["anchor", "slot", "score", "id"])

    return whole.mapInArrow(run, "anchor long, slot long, score long, id long")


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    """anchor, slot and rank, score, id of the best `keep` entries of all tasks; a task brings `keep` of them at most."""
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, keep)
    listed = found.groupBy("anchor", "slot").agg(first.alias("best"))
    return listed.select("anchor", "slot", F.posexplode("best").alias("place", "x")).select(
        "anchor", "slot", (F.col("place") + 1).alias("rank"), (-F.col("x.minus")).alias("score"), F.col("x.id").alias("id"))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, factor: int = 256,
    positives: int = 5, negatives: int = 5, from_percent: int = 80, to_percent: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `is_anchor` picks the anchors by `id`; `label` (a column of `rows`) is the class.  An anchor's positives are its first
    `positives` other rows of its label; a positive's negatives the first `negatives` rows of other labels whose score lies
    between the two percentages of the positive's score.  Higher scores come first, then smaller ids.
    Rows with a null id, label or vector, or a null or non-finite component, and empty vectors take no part.
    Other rows are those of another id.  Repeated rows count each as candidates; anchors of one id, label and
    vector are one.  Only vectors of the anchor's length are compared.  Whole components are held within 2^20.
    An empty table, no anchors or no positives give an empty result.  Other columns are not read.
    """
    vec = F.col(vec_col).cast("array<double>")
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), vec.alias("vec"))
    whole = stored(chosen.filter("id IS NOT NULL AND label IS NOT NULL").filter(finite(F.col("vec")) & (F.size("vec") > 0)).select("id", "label", scaled(F.col("vec"), factor, MOST).alias("whole")), "whole-vectors")
    asked = stored(whole.filter(is_anchor).distinct(), "anchors")
    blocks = max(1, -(-asked.count() // ANCHORS))
    lengths = [r["n"] for r in asked.select(F.size("whole").alias("n")).distinct().collect()]
    parts = []
    for block in range(blocks):
        for length in lengths:
            of_block = asked.filter((F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) & (F.size("whole") == length)).orderBy("id", "label", "whole").collect()
            if not of_block:
                continue
            anchors = {"id": np.array([r["id"] for r in of_block], np.int64), "label": np.array([r["label"] for r in of_block], np.int64), "whole": np.array([r["whole"] for r in of_block], np.int64)}
            near = _ranked(_pass(whole, anchors, None, 1, positives), positives).collect()
            windows = np.zeros((len(of_block), positives, 2), np.int64)
            windows[:, :, 0] = 1  # unused: from 1 to 0
            for r in near:
                # whole scores s with from * p <= 100 * s <= to * p
                windows[r["anchor"], r["rank"] - 1] = -(-from_percent * r["score"] // 100), to_percent * r["score"] // 100
            spark = rows.sparkSession
            names = spark.createDataFrame([(r["anchor"], r["rank"] - 1, int(anchors["id"][r["anchor"]]), r["id"], r["score"]) for r in near], "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
            far = _ranked(_pass(whole, anchors, windows, positives, negatives), negatives)
            answer = far.join(names, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            parts.append(stored(answer, "hard-negatives"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
