"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear support vector machine.

Features are the byte n-grams of 1 to 4 bytes of the whole text, present or
not, hashed to a fixed number of slots, and n-grams of one repeated word or
line, whatever it is.  A naive Bayes log-count ratio scales
each slot, a document's scaled vector has unit length, and dual coordinate
descent fits a hinge-loss model on it.  A logistic curve, fitted on labelled
rows that the descent did not see, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.shared import batches

SLOT_BITS = 18
#: Labelled rows the model is fitted on, at most; they and their features fit on the driver.
SAMPLE = 6000


#: Repeats of a word or line up to which n-grams are told apart.
LONGEST = 8


def longest_run(items: list[bytes]) -> int:
    """How often an item follows itself at once, at most; blank lines don't count."""
    most = run = 0
    for before, item in zip(items, items[1:], strict=False):
        run = run + 1 if item == before and item else 0
        if run > most:
            most = run
    return most


def slots_of(data: bytes) -> np.ndarray:
    """Distinct feature slots of a text, sorted."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    found, gram = [], np.zeros(len(a), np.uint32)
    for n in range(1, 5):
        if len(a) < n:
            break
        gram = (gram[: len(a) - n + 1] << np.uint32(8)) | a[n - 1:]
        mixed = (gram ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
        found.append(mixed >> np.uint32(32 - SLOT_BITS))
    for kind, items in enumerate((data.split(), data.split(b"\n"))):
        found.append(np.arange(min(longest_run(items), LONGEST), dtype=np.uint32) * 2 + kind)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def unpacked(column: pa.Array) -> list[np.ndarray]:
    """The slots of every row, as views on the column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 4
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint32, ends[-1] if len(ends) else 0)
    return [flat[b:e] for b, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@dataclass
class Model:
    """Weight per slot (already scaled by `ratio`), bias, and the logistic curve of margins."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        scale = np.sqrt(np.sum(self.ratio[slots] ** 2, dtype=np.float64)) if len(slots) else 0.0
        return float(np.sum(self.weight[slots], dtype=np.float64) / scale + self.bias) if scale else self.bias

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.offset, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of (share of a slot in class 1 / in class 0), counts smoothed by one."""
    counts = np.ones((2, 1 << SLOT_BITS))
    for slots, label in zip(rows, labels, strict=True):
        counts[int(label), slots] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss support vector machine; the bias is one more constant feature."""
    signs = np.where(labels > 0, 1.0, -1.0)
    # scaled vectors are made where they are used: held, they were twice the size of the rows
    lengths = [max(np.sqrt((ratio[s] ** 2).sum()), 1e-12) for s in rows]
    squares = np.array([((ratio[s] / length) ** 2).sum() + 1 for s, length in zip(rows, lengths, strict=True)])
    # the rarer class weighs as much as the other one
    limits = cost * len(labels) / 2 / np.where(labels > 0, max((labels > 0).sum(), 1), max((labels == 0).sum(), 1))
    weight, bias, alpha = np.zeros(1 << SLOT_BITS), 0.0, np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            slots, value, sign = rows[i], ratio[rows[i]] / lengths[i], signs[i]
            gradient = sign * (weight[slots] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), limits[i])
            change = (new - alpha[i]) * sign
            if change:
                weight[slots] += change * value
                bias += change
                alpha[i] = new
                most = max(most, abs(change))
        if most < 1e-4:
            break
    return weight, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, with smoothed targets (Newton steps)."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, float(b))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 30) -> Model:
    """Model of feature rows; every fifth row only sets the logistic curve.

    With fewer than 10 rows of a class the score is the smoothed share of class 1.
    """
    flat = np.zeros(1 << SLOT_BITS, np.float32)
    if min((labels > 0).sum(), (labels == 0).sum()) < 10:
        share = ((labels > 0).sum() + 1) / (len(labels) + 2)
        return Model(flat, flat, 0.0, 1.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(rows)) % 5 == 0
    seen = [r for r, out in zip(rows, aside, strict=True) if not out]
    ratio = log_count_ratios(seen, labels[~aside])
    weight, bias = descend(seen, labels[~aside], ratio, cost, rounds)
    model = Model(ratio.astype(np.float32), (weight * ratio).astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([model.margin(r) for r, out in zip(rows, aside, strict=True) if out])
    model.slope, model.offset = logistic(margins, labels[aside].astype(float))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most `sample` labelled rows, those of the smallest hash of the id, among the labels where `learn` holds.

    Null ids and null labels teach nothing; an id labelled twice counts with its
    largest label.  Only the sampled ids go to the tasks that read the texts,
    and only the features of those texts come to the driver.
    """
    chosen = (
        labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(sample)
    )

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, text_col):
            slots = [slots_of(x.as_py() or b"").tobytes() for x in pc.cast(batch.column(text_col), pa.binary())]
            yield pa.record_batch([batch.column(id_col), batch.column("label"), pa.array(slots, pa.binary())], names=["id", "label", "slots"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, text_col, "label")
    found = read.mapInArrow(features, f"id {kind}, label int, slots binary").toArrow().sort_by([("id", "ascending"), ("slots", "ascending")])
    rows = [x for chunk in found["slots"].chunks for x in unpacked(chunk)]
    order = np.random.default_rng(11).permutation(len(rows))
    model = fit_rows([rows[i] for i in order], np.array(found["label"].to_pylist(), int)[order])
    del found, rows
    pa.default_memory_pool().release_unused()  # the driver goes on with other steps
    return model


def quality_scores(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: all columns of `docs`, then score (double, 0 to 1) and predicted (1 if score >= `least`).

    Reads nothing but the text.  Null and empty texts get the score of a text
    without features.  One row per input row, whatever the id; columns of `docs` named score
    or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weight, model.bias, model.slope, model.offset))
    docs = docs.drop("score", "predicted")
    names = [*docs.columns, "score"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches(parts, text_col):
            scores = [model.score(slots_of(x.as_py() or b"")) for x in pc.cast(batch.column(text_col), pa.binary())]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=names)

    scored = docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("score")).schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
