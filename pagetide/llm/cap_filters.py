"""Near-duplicate embeddings by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it when their inner product is at least
`alpha`.  The directions of a table are all sums of one code vector per block
of a rotated space, so that those a vector passes are listed by decoding:
code vectors of a block are looked at only where the best of the other blocks
could still lift the sum to `alpha`.  Two near vectors pass common filters; the
number of filters is set so that a pair at the threshold shares `SHARED` of
them on average, over `TABLES` independent tables.  The caps shrink as the table
grows, so a filter holds a few unrelated vectors at every size.

How filters become links without all pairs of rows: equal vectors are one class.
A class lives in its home, the filter it passes best.  Filters are joined to pairs
of homes, and a pair of homes is compared once, in blocks, by a matrix product;
a block gives a count and one edge per class, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.graph import components
from pagetide.llm.shared import stored
from pagetide.llm.vectors import finite, matrix, of_one_length, rotation, whole_vectors

TABLES, BLOCKS = 32, 2
#: Filters that a pair at the threshold shares on average, unrelated classes a filter may hold, widest and narrowest cap.
SHARED, HELD, WIDEST, NARROWEST = 32, 1.0, 1e-4, 0.75
#: Members of a home compared with as many others in one go; scores computed in one go.
MEMBERS, SCORES = 1024, 1 << 20


def _measures(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Heights (falling from 1 to -1) and the share of the sphere above each."""
    angles = np.linspace(0, np.pi, 40_001)
    with np.errstate(divide="ignore"):
        log = (dims - 2) * np.log(np.sin(angles)) if dims > 2 else np.zeros(len(angles))
    density = np.exp(np.where(np.isfinite(log), log, -np.inf))
    total = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return np.cos(angles), total / total[-1]


def cap_shape(classes: int, dims: int, cosine: float) -> tuple[float, int]:
    """alpha, and the code vectors of each block, for so many vectors of `dims` (2 at least) components."""
    height, above = _measures(dims)
    at = int(np.searchsorted(above, min(WIDEST, HELD / max(classes, 1))))
    at = max(at, int(np.searchsorted(-height, -NARROWEST)))
    alpha, share = float(height[at]), float(above[at])
    # the chance that a vector at `cosine` passes a filter, too: over the heights of the first, the cap of the second around it
    top = height[1:at + 1]
    weight = np.diff(above[:at + 1])
    wanted = (alpha - cosine * top) / np.maximum(math.sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(1 - top * top, 0)), 1e-12)
    h, a = _measures(max(dims - 1, 2))
    both = float((weight * np.interp(-np.clip(wanted, -1, 1), -h, a)).sum() / weight.sum())
    filters = SHARED / max(both, 0.05) / share
    return alpha, max(2, math.ceil((filters / TABLES) ** (1 / BLOCKS)))


def product_code(dims: int, size: int, table: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and the code vectors (block, number, component) of one table; the space is padded to whole blocks."""
    width = -(-dims // BLOCKS)
    code = np.random.default_rng([seed, dims, size, table]).standard_normal((BLOCKS, size, width))
    return rotation(width * BLOCKS, seed, table), code / (np.linalg.norm(code, axis=2, keepdims=True) * math.sqrt(BLOCKS))


def decoded(unit: np.ndarray, turn: np.ndarray, code: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, number and inner product of every filter of a table that a row passes."""
    blocks, size, width = code.shape
    turned = np.pad(unit, ((0, 0), (0, blocks * width - unit.shape[1]))) @ turn
    scores = np.stack([turned[:, b * width:(b + 1) * width] @ code[b].T for b in range(blocks)], 1)
    best = scores.max(2)
    need = alpha - best.sum(1, keepdims=True) + best
    row, number, value = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for b in range(blocks):
        at, entry = np.nonzero(scores[:, b] >= need[:, b, None])
        start = np.searchsorted(at, np.arange(len(unit) + 1))
        many = np.diff(start)[row]
        before = np.repeat(np.arange(len(row)), many)
        entry = entry[start[row][before] + np.arange(len(before)) - np.repeat(np.cumsum(many) - many, many)]
        row = row[before]
        value = value[before] + scores[row, b, entry]
        keep = value >= alpha - best[row, b + 1:].sum(1)
        row, number, value = row[keep], (number[before] * size + entry)[keep], value[keep]
    return row, number, value


def caps(classes: DataFrame, count: int, cosine: float, seed: int) -> DataFrame:
    """class, first, w, dims, home and filters of each class, and its vector packed, as doubles where `wide`, else as floats, which are the same numbers.

    A class that passes no filter at all has its best code vectors of the first table as the only one.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, tuple[float, list]] = {}
        for batch in parts:
            vectors = batch.column("vec")
            for rows in of_one_length(vectors):
                raw = matrix(vectors.take(pa.array(rows)))
                dims = raw.shape[1]
                if dims not in codes:
                    alpha, size = cap_shape(count, max(dims, 2), cosine)
                    codes[dims] = alpha, [product_code(max(dims, 2), size, t, seed) for t in range(TABLES)]
                alpha, tables = codes[dims]
                size = tables[0][1].shape[1]
                step = max(1, SCORES // (size * BLOCKS))
                for k in range(0, len(raw), step):
                    # a power of two as the scale keeps very small and very large vectors in range
                    part = raw[k:k + step]
                    part = np.ldexp(part, -np.frexp(np.abs(part).max(1))[1][:, None])
                    wide = (part.astype(np.float32) != part).any(1)
                    unit = part / np.linalg.norm(part, axis=1, keepdims=True)
                    found = [decoded(unit, *tables[t], alpha) for t in range(TABLES)]
                    first = tables[0][1]
                    turned = np.pad(unit, ((0, 0), (0, first.shape[0] * first.shape[2] - dims))) @ tables[0][0]
                    entry = [(turned[:, b * first.shape[2]:(b + 1) * first.shape[2]] @ first[b].T).argmax(1) for b in range(BLOCKS)]
                    spare = np.zeros(len(part), np.int64)
                    for e in entry:
                        spare = spare * size + e
                    row = np.concatenate([*(r for r, _, _ in found), np.arange(len(part))])
                    number = np.concatenate([*(n * TABLES + t for t, (_, n, _) in enumerate(found)), spare * TABLES])
                    value = np.concatenate([*(v for _, _, v in found), np.full(len(part), -1.0)])
                    order = np.lexsort((number, -value, row))
                    row, number = row[order], number[order]
                    start = np.searchsorted(row, np.arange(len(part)))
                    sizes = np.diff(np.append(start, len(row)))
                    spared = sizes == 1
                    keep = np.ones(len(row), bool)
                    keep[(start + sizes - 1)[~spared]] = False  # the spare one, last by its value
                    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.where(spared, 1, sizes - 1))).astype(np.int32), number[keep])
                    here = batch.take(pa.array(rows[k:k + step]))
                    yield pa.record_batch([
                        here.column("class"), here.column("first"), here.column("w"), pa.array(np.full(len(part), dims, np.int32)), pa.array(number[start]),
                        lists, pa.array(wide), pa.array([x.tobytes() if f else x.astype(np.float32).tobytes() for x, f in zip(part, wide, strict=True)], pa.binary()),
                    ], names=["class", "first", "w", "dims", "home", "filters", "wide", "raw"])

    return classes.select("class", "first", "w", "vec").mapInArrow(run, "class long, first long, w long, dims int, home long, filters array<long>, wide boolean, raw binary")


def home_blocks(held: DataFrame) -> DataFrame:
    """dims, home, chunk and members (class, first, w, wide, raw): homes in blocks of about `MEMBERS`, by a hash of the class."""
    large = held.groupBy("dims", "home").agg(F.count("*").alias("n")).filter(F.col("n") > MEMBERS)
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / MEMBERS)
    placed = held.join(large, ["dims", "home"], "left").withColumn("chunk", F.pmod(F.xxhash64("class"), chunks).cast("int"))
    return placed.groupBy("dims", "home", "chunk").agg(F.collect_list(F.struct("class", "first", "w", "wide", "raw")).alias("members"))


def home_pairs(held: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of blocks (dims, home_a, chunk_a, home_b, chunk_b) whose homes share a filter, each once, and each block with itself and its home's others."""
    listed = held.select("dims", "home", F.explode("filters").alias("filter")).distinct()
    pairs = listed.withColumnRenamed("home", "home_a").join(listed.withColumnRenamed("home", "home_b"), ["dims", "filter"]).filter("home_a < home_b").select("dims", "home_a", "home_b").distinct()
    keys = blocks.select("dims", "home", "chunk", (F.size("members") > 1).alias("several"))
    a, b = (keys.select("dims", F.col("home").alias(f"home_{x}"), F.col("chunk").alias(f"chunk_{x}"), F.col("several").alias(f"several_{x}")) for x in "ab")
    across = pairs.join(a, ["dims", "home_a"]).join(b, ["dims", "home_b"])
    within = a.join(b.withColumnRenamed("home_b", "home_a"), ["dims", "home_a"]).withColumn("home_b", F.col("home_a")).filter("chunk_a < chunk_b OR chunk_a = chunk_b AND several_a")
    names = ["dims", "home_a", "chunk_a", "home_b", "chunk_b"]
    return across.select(names).unionByName(within.select(names))


def _joined_up(linked: np.ndarray) -> np.ndarray:
    """For rows and columns of a matrix of links: the number of the smallest row in their part of the graph; its own for a column without links."""
    n, m = linked.shape
    rows, columns = np.arange(n), np.arange(n, n + m)
    while True:
        far = np.where(linked, rows[:, None], n + m).min(0, initial=n + m)
        columns = np.minimum(columns, far)
        near = np.minimum(rows, np.where(linked, columns[None, :], n + m).min(1, initial=n + m))
        if (near == rows).all():
            return np.concatenate([rows, columns])
        rows = near


def _vectors(members: pa.StructArray) -> np.ndarray:
    """The components of all members, one after the other."""
    raw, wide = members.field("raw"), members.field("wide").to_numpy(zero_copy_only=False)
    if wide.all() or not wide.any():
        ends = raw.offsets.to_numpy() if hasattr(raw, "offsets") else np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(raw) else np.zeros(0, np.uint8)
        return np.frombuffer(data.tobytes(), np.float64 if wide.any() else np.float32).astype(np.float64)
    return np.concatenate([np.frombuffer(x, np.float64 if w else np.float32) for x, w in zip(raw.to_pylist(), wide, strict=True)], dtype=np.float64)


def links(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """class and first, n (linked vectors in other classes), near and near_first (a class it hangs together with), from every pair of blocks; classes without a link do not come."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sides = []
            for name in ("a", "b"):
                column = batch.column(name)
                members = column.flatten()
                ids = np.stack([members.field("class").to_numpy(), members.field("first").to_numpy()], 1)
                sides.append((column.offsets.to_numpy() - column.offsets[0].as_py(), ids, members.field("w").to_numpy(), _vectors(members)))
            dims = batch.column("dims").to_numpy().astype(np.int64)
            same = batch.column("same").to_numpy(zero_copy_only=False)
            starts = [np.concatenate([[0], np.cumsum(np.diff(at) * dims)]) for at, _, _, _ in sides]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            single = (np.diff(sides[0][0]) == 1) & (np.diff(sides[1][0]) == 1)
            for d in np.unique(dims[single]):
                at = np.flatnonzero(single & (dims == d))
                x, y = (side[3][start[at][:, None] + np.arange(d)] for side, start in zip(sides, starts, strict=True))
                near = np.einsum("ij,ij->i", x, y) >= cosine * np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                i, j = sides[0][0][:-1][at[near]], sides[1][0][:-1][at[near]]
                out += [(sides[0][1][i], sides[1][2][j], sides[1][1][j]), (sides[1][1][j], sides[0][2][i], sides[1][1][j])]
            for r in np.flatnonzero(~single):
                (ids, w, x), (others, v, y) = (
                    (cls[at[r]:at[r + 1]], weight[at[r]:at[r + 1]], unit[start[r]:start[r + 1]].reshape(-1, dims[r]))
                    for (at, cls, weight, unit), start in zip(sides, starts, strict=True))
                linked = x @ y.T >= cosine * np.sqrt(np.einsum("ij,ij->i", x, x)[:, None] * np.einsum("ij,ij->i", y, y)[None, :])
                if same[r]:
                    linked &= ids[:, None, 0] != others[None, :, 0]
                if not linked.any():
                    continue
                label = _joined_up(linked)
                everyone = np.concatenate([ids, others])
                counts = np.concatenate([linked @ v, np.zeros(len(others), np.int64) if same[r] else linked.T @ w])
                some = np.concatenate([linked.any(1), linked.any(0)])
                out.append((everyone[some], counts[some], everyone[label[some]]))
            if out:
                cls, n, near = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (cls[:, 0], cls[:, 1], n, near[:, 0], near[:, 1])], names=["class", "first", "n", "near", "near_first"])

    both = pairs
    for x in "ab":
        both = both.join(blocks.select("dims", F.col("home").alias(f"home_{x}"), F.col("chunk").alias(f"chunk_{x}"), F.col("members").alias(x)), ["dims", f"home_{x}", f"chunk_{x}"])
    same = (F.col("home_a") == F.col("home_b")) & (F.col("chunk_a") == F.col("chunk_b"))
    return both.select("dims", same.alias("same"), "a", "b").mapInArrow(run, "class long, first long, n long, near long, near_first long")


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, seed: int = 20) -> DataFrame:
    """id, n_links (other rows at a cosine of `cosine` or more), component (smallest id reachable) and kept (is it the row's own), for every row.

    A null, empty or zero vector, one with a null or non-finite component, and a row without an id
    link with nothing: n_links 0, component its own id, kept.  Vectors of different length
    never link.  Ids are whole numbers.  Each repeated row is a vector of its own; rows of one id and different vectors
    are different vectors.  An empty table gives an empty result.  Other columns are not read.
    A link is missed with the chance that none of `SHARED` expected filters is shared, below one in 10,000
    for a pair just at the threshold and falling fast above it.
    """
    usable = finite(F.col("vec")) & F.exists("vec", lambda x: x != 0) & F.col("id").isNotNull()
    all_rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    valid = whole_vectors(rows, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    grouped = valid.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("w"))
    classes = stored(grouped.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    held = stored(caps(classes, classes.count(), cosine, seed), "vector-caps")
    blocks = stored(home_blocks(held), "vector-homes")
    found = stored(links(home_pairs(held, blocks), blocks, cosine), "vector-links")
    counted = found.groupBy("class").agg(F.sum("n").alias("n"))
    # nodes are numbered by the smallest id first, so that the least of a component names it
    node, near = F.struct("first", "class"), F.struct(F.col("near_first").alias("first"), F.col("near").alias("class"))
    parts = components(found.filter("class <> near").select(node.alias("a"), near.alias("b")))
    named = parts.select(F.col("node.class").alias("class"), F.col("component.first").alias("least"))
    answers = classes.join(counted, "class", "left").join(named, "class", "left").select("vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("least", "first").alias("component"))
    known = all_rows.filter(usable).join(answers, "vec").select("id", "n_links", "component")
    alone = all_rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return known.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component"))).withColumnRenamed("id", id_col)
