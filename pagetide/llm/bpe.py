"""Byte-level pair encoding: ranked merges folded over the bytes of distinct words.

A text is cut into matches of a pattern.  The words found in most documents
are encoded once, by a fold of higher-order functions over their bytes with
the ranks as a literal; that dictionary has at most `dictionary` words and goes
to every task.  The other words, which are few tokens but most of the distinct
ones, are merged inside the task that reads their text: to join them back
would shuffle every text.  Both roads merge the pair of lowest rank, leftmost
first, one at a time.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions.once import let
from pagetide.llm.shared import batches, stored

#: Buckets of the literal rank map: a lookup reads one bucket of about one entry.
BUCKETS = 1 << 16
#: Words a worker remembers besides the dictionary before it starts afresh.
REMEMBERED = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece to rank, from a file of base64 pieces and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of buckets, each an array of (piece, rank)."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS].append({"p": base64.b64encode(piece).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps({"b": buckets})), "b array<array<struct<p: binary, r: int>>>")["b"]


def _rank(buckets: Column, piece: Column) -> Column:
    """Rank of a piece, null if it is none."""
    return F.get(F.filter(F.get(buckets, (F.crc32(piece) % BUCKETS).cast("int")), lambda x: x["p"] == piece), F.lit(0))["r"]


def encoded_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """`word` (binary) and its `ids` (array of int) by folding merges over its bytes.

    The state of the fold is the pieces and the rank of every adjacent pair;
    one step merges the lowest pair, leftmost first, and ranks only the two
    pairs it made.  A word of n bytes takes at most n - 1 steps.
    """

    def merged(buckets: Column, state: Column) -> Column:
        def at(lowest: Column) -> Column:
            return F.array_position(state["ranks"], lowest).cast("int")

        def step(i: Column) -> Column:
            parts, pairs = state["parts"], state["ranks"]
            size = F.size(parts)
            piece = F.concat(F.get(parts, i - 1), F.get(parts, i))
            new = let(piece, lambda p: F.struct(
                F.concat(F.slice(parts, F.lit(1), i - 1), F.array(p), F.slice(parts, i + 2, size)).alias("parts"),
                F.concat(
                    F.slice(pairs, F.lit(1), F.greatest(i - 2, F.lit(0))),
                    F.when(i > 1, F.array(_rank(buckets, F.concat(F.get(parts, i - 2), p)))).otherwise(F.array().cast("array<int>")),
                    F.when(i + 1 < size, F.array(_rank(buckets, F.concat(p, F.get(parts, i + 1))))).otherwise(F.array().cast("array<int>")),
                    F.slice(pairs, i + 2, size),
                ).alias("ranks"),
            ))
            return new

        lowest = F.array_min(state["ranks"])
        return F.when(lowest.isNull(), state).otherwise(let(lowest, lambda m: let(at(m), step)))

    word = F.col(word_col)

    def folded(buckets: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(word, i, F.lit(1)))
        start = let(parts, lambda p: F.struct(
            p.alias("parts"),
            F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x, i: _rank(buckets, F.concat(F.get(p, i), x))).alias("ranks"),
        ))
        end = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, lambda state, _: merged(buckets, state))
        return F.transform(end["parts"], lambda p: _rank(buckets, p))

    return words.select(word_col, let(rank_literal(ranks), folded).alias("ids"))


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the same merges with a heap of pairs, n log n for a word of n bytes."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != end:
            continue
        gone[j] = 1
        after[i] = end
        if end < n:
            before[end] = i
            if (rank := ranks.get(word[i:after[end]])) is not None:
                heapq.heappush(heap, (rank, i, after[end]))
        if before[i] >= 0 and (rank := ranks.get(word[before[i]:end])) is not None:
            heapq.heappush(heap, (rank, before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:after[i]]])
        i = after[i]
    return ids


def pattern_words(text: Column, pattern: str) -> Column:
    """Matches of the pattern in order, its classes read as Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def frequent_words(docs: DataFrame, pattern: str, most: int, text_col: str = "text") -> DataFrame:
    """At most `most` words (binary): all that stand in at least 2^k documents, for the smallest k that fits.

    The counts cover all documents.  They are kept in the shared folder, as two
    questions are asked of them; only a row per power of two comes to the driver.
    """
    word = F.explode(F.array_distinct(pattern_words(F.col(text_col), pattern))).alias("word")
    counts = stored(docs.select(word).groupBy("word").count().filter("count > 1"), "words")
    level = F.floor(F.log2("count")).cast("int")
    held, least = 0, 63
    for k, n in sorted(counts.groupBy(level.alias("k")).count().collect(), reverse=True):
        held += n
        if held > most:
            break
        least = k
    return counts.filter(level >= least).select(F.col("word").cast("binary").alias("word"))


class _Ids(dict):
    """Packed ids of words: the dictionary's, and those met so far."""

    def __init__(self, known: dict[bytes, bytes], ranks: dict[bytes, int]):
        super().__init__(known)
        self.known, self.ranks = known, ranks

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= len(self.known) + REMEMBERED:
            self.clear()
            self.update(self.known)
        ids = self[word] = np.array(merged_ids(word, self.ranks), "<u4").tobytes()
        return ids


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(docs: DataFrame, ranks_path: str, pattern: str, dictionary: int, text_col: str) -> Step:
    """What a task does with batches of id, size and words: id and ids."""
    ranks = read_ranks(ranks_path)
    found = encoded_words(frequent_words(docs, pattern, dictionary, text_col), ranks).toArrow()
    known = {}
    for batch in found.to_batches(1 << 12):  # no list of all ids: what Python once holds for small objects it keeps
        flat = batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)).tolist()
        known |= {word: flat[4 * b:4 * e] for word, b, e in zip(batch.column("word").to_pylist(), [0, *ends[:-1]], ends, strict=True)}
    del found
    pa.default_memory_pool().release_unused()
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _Ids(*shared.value)
        for batch in batches(parts, "size", 1 << 20):
            lists = batch.column("words")
            tokens = pc.dictionary_encode(pc.cast(lists.flatten(), pa.binary()))
            packed = [ids_of[w] for w in tokens.dictionary.to_pylist()]
            flat = np.frombuffer(b"".join(packed), "<u4")
            sizes = np.array([len(x) for x in packed], np.int64) // 4
            starts = np.cumsum(sizes) - sizes
            which = tokens.indices.to_numpy(zero_copy_only=False)
            ids = flat[spans(starts[which], sizes[which])]
            upto = np.concatenate([[0], np.cumsum(sizes[which])])
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            bounds = np.concatenate([[0], upto[ends]]) * 4
            out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.record_batch([batch.column("id"), out], names=["id", "ids"])

    return run


def _decoding(spark: SparkSession, ranks_path: str) -> Step:
    """What a task does with batches that have ids: data in addition."""
    ranks = read_ranks(ranks_path)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shared = spark.sparkContext.broadcast(pieces)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in shared.value], np.int64)
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(shared.value), np.uint8)
        for batch in batches(parts, "ids", 2 << 20):
            data = []
            for packed in batch.column("ids"):
                ids = np.frombuffer(packed.as_py() or b"", "<u4")
                if len(ids) and (ids.max() >= len(sizes) or not sizes[ids].all()):
                    raise ValueError("an id is no rank of the vocabulary")
                data.append(flat[spans(starts[ids], sizes[ids])].tobytes())
            yield pa.record_batch([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])

    return run


def _words_by_id(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.octet_length(text_col).alias("size"), pattern_words(F.col(text_col), pattern).alias("words"))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, dictionary: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, each match of `pattern` encoded by itself.

    `ranks_path` is a rank file that the driver can read; it must hold all 256
    bytes.  Returns one row per input row: id, ids (binary: little-endian
    unsigned 32-bit integers).  Null and empty texts have empty ids.  Rows with
    a null id or a repeated one are encoded like others; more columns are
    ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    encode = _encoding(docs, ranks_path, pattern, dictionary, text_col)
    return _words_by_id(docs, pattern, id_col, text_col).mapInArrow(encode, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of packed ids: the pieces one after the other.

    Returns one row per input row: id, ids, data (binary); other columns are
    dropped.  Null ids decode to no bytes.  An id that is no rank raises an
    error.
    """
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decoding(encoded.sparkSession, ranks_path), f"id {kind}, ids binary, data binary").withColumnsRenamed({"id": id_col, "ids": ids_col})


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, dictionary: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids and the bytes they decode to (data), in one pass over the texts: a task decodes what it has encoded."""
    kind = docs.schema[id_col].dataType.simpleString()
    encode, decode = _encoding(docs, ranks_path, pattern, dictionary, text_col), _decoding(docs.sparkSession, ranks_path)

    def both(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decode(encode(parts))

    return _words_by_id(docs, pattern, id_col, text_col).mapInArrow(both, f"id {kind}, ids binary, data binary").withColumnRenamed("id", id_col)
