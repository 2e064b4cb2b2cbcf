"""Exact substring deduplication by sorting suffixes at synchronizing places.

A byte goes if a string of `width` bytes over it also starts in a document of a
smaller id.  Every string has a minimizer, the leftmost smallest hash among its
20-byte grams.  Equal strings have it at the same place, so only the suffixes
that begin at minimizers need be sorted, about one position in sixteen (a
synchronizing set, where a difference cover would take two in three):

1. A task takes all minimizers of one bucket of hashes, each with the bytes that
   its strings have on both sides.
2. It sorts the suffixes from the minimizers on, and the reversed prefixes in
   front of them.  With the common prefixes of neighbours, a running count names
   the first k bytes of every suffix and the last k of every prefix, for any k.
3. The string that begins s bytes before a minimizer is the pair of the prefix
   name for s bytes and the suffix name for `width` - s.  Equal pairs are equal
   strings, byte for byte; all but those of the smallest id are answered.

What is sorted is first cut down without losing a match.  Strings that recur
hold a minimizer found in two documents; other text is left out.  The
rest is cut at places that depend on content only; equal pieces are sorted once,
for the smallest id that has them, so thousands of copies cost one.

Spark shuffles packed arrays by bucket of hashes; a task
sorts one bucket with numpy.  Buckets are many times `spark.sql.shuffle.partitions`;
set that so that a partition fits a task.  A string that a third of all documents
hold is one entry per task that read them.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.bpe import spans
from pagetide.llm.shared import batches, dropped, stored
from pagetide.llm.word_hashes import mix

WIDTH = 50
GRAM = 20
#: Minimizers a task gathers before it hands them on.
GATHERED = 1 << 19
#: Pieces are cut at one minimizer in so many, but hold no fewer and no more starts than these.
CUT_EVERY, LEAST, MOST = 8, 64, 4096
#: Digests of pieces a task remembers, so as to send the bytes of a piece once.
REMEMBERED = 1 << 17
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407, 0xBF58476D1CE4E5B9)]
#: In place of an id: nobody waits for an answer.
NOBODY = np.int64(-(1 << 63))
#: In place of an offset: a piece that goes as a whole, a place of a piece.
WHOLE, PLACE = -1, -2
#: Bytes hashed in one go.
_SPAN = 1 << 15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` (9 to 24) bytes from every position that has as many."""
    out = np.empty(max(len(data) - size + 1, 0), np.uint64)
    data = np.ascontiguousarray(data)
    for k in range(0, len(out), _SPAN):
        n = min(_SPAN, len(out) - k)
        letters = np.ndarray((n + size - 8,), "<u8", data, k, (1,)).astype(np.uint64)
        h = letters[:n] * _FACTORS[0]
        for at, factor in zip(sorted({min(8, size - 8), size - 8}), _FACTORS[1:], strict=False):
            h ^= h >> np.uint64(29)
            h += letters[at:at + n] * factor
        h ^= h >> np.uint64(32)
        h *= _FACTORS[3]
        h ^= h >> np.uint64(29)
        out[k:k + n] = h
    return out


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every `width` neighbours, from those of 2, 4, 8 and so on."""
    extreme = np.minimum if least else np.maximum
    n = max(len(values) - width + 1, 0)
    out = np.empty(n, values.dtype)
    for k in range(0, n, _SPAN):
        part, reach = values[k:min(k + _SPAN, n) + width - 1], 1
        while reach < width:
            step = min(reach, width - reach)
            part = extreme(part[:-step], part[step:])
            reach += step
        out[k:k + _SPAN] = part
    return out


def minimizers(data: np.ndarray, width: int = WIDTH, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of `width` bytes with one minimizer: its position, the run's first start and the end of its starts (a column each), and the smallest hash from every start.

    `data` may be texts of `sizes` laid end to end; strings across texts are in no run.
    """
    n, span = len(data) - width + 1, width - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros((2, 0), np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, GRAM)
    lows = sliding(hashes, span, True)
    ends = np.array([len(data)]) if sizes is None else np.cumsum(sizes)
    begins = np.concatenate([[0], ends[:-1]])
    # the minimizer changes where a smaller gram comes in or it is left behind itself
    new = np.ones(n, bool)
    new[1:] = (lows[1:] != lows[:-1]) | (hashes[:n - 1] == lows[:-1])
    new[begins[begins < n]] = True
    first = np.flatnonzero(new)
    limit = (ends - width + 1)[np.searchsorted(ends, first, "right")]
    end = np.minimum(np.append(first[1:], n), limit)
    first, end = first[first < limit], end[first < limit]
    low = lows[first]
    at = first + span - 1
    left = hashes[end - 1] == low
    at[left] = end[left] - 1
    # neither come in with the run nor left behind with it: looked for
    rest = np.flatnonzero(~left & ~((first > 0) & (lows[first - 1] > low)))
    at[rest] = first[rest] + np.argmax(hashes[first[rest][:, None] + np.arange(span)] == low[rest][:, None], axis=1)
    return at, np.stack([first, end]), lows


def _packed(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values).astype(kind, copy=False).tobytes()


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as differences, all lowest bytes first: what Spark's compression makes small."""
    return np.diff(values.astype("<i8"), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all rows packed by `_squeezed`."""
    parts = [np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(8, -1).T).view("<i8").ravel().cumsum() for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts `key`, where runs of equal keys begin in it, and the run of every sorted entry."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    run = np.zeros(len(ranked), np.int64)
    run[first[1:]] = 1
    return order, first, np.cumsum(run)


def _bounds(first: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Where each run begins and ends."""
    return list(zip(first.tolist(), [*first[1:].tolist(), n], strict=True)) if len(first) else []


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the size of each."""
    texts = pc.cast(column, pa.binary())
    return np.frombuffer(b"".join(texts.to_pylist()), np.uint8), pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now rather than when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def recurring(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """doc and `hashes` (packed, several rows a document): its minimizers that stand in another document too.

    A task keeps one entry per hash: where it has seen a hash in two documents
    both are told at once, and what goes to the bucket needs no answer.
    """

    def told(hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        order, first, _ = _groups(ids)
        for b, e in _bounds(first, len(ids)):
            yield -1 - int(ids[order[b]]) % buckets, b"", _packed(ids[order[b]:order[b] + 1], "<i8"), _packed(hashes[order[b:e]], "<u8")

    def handed(hashes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        h, d = np.concatenate(hashes), np.concatenate(ids)
        order, first, run = _groups(h)
        h, d = h[order], d[order]
        low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
        twice = (low != high)[run]
        rows = list(told(h[twice], d[twice]))
        one, answer = h[first], np.where(low == high, low, NOBODY)
        bucket = (one >> np.uint64(20)) % np.uint64(buckets)
        order, first, _ = _groups(bucket)
        for b, e in _bounds(first, len(order)):
            some = order[b:e]
            rows.append((int(bucket[some[0]]), _packed(one[some], "<u8"), _packed(answer[some], "<i8"), b""))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "ids", "hashes"])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held = [], [], 0
        for batch in batches(parts, "text", 1 << 20):
            data, sizes = laid_out(batch.column("text"))
            _, runs, lows = minimizers(data, width, sizes)
            found, whose = lows[runs[0]], np.searchsorted(np.cumsum(sizes), runs[0], "right")
            if len(found):
                hashes.append(found)
                ids.append(batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)[whose])
                held += len(found)
            if held > GATHERED:
                yield handed(hashes, ids)
                hashes, ids, held = [], [], 0
        if held:
            yield handed(hashes, ids)
            del hashes, ids
        pa.default_memory_pool().release_unused()  # the worker goes on with other steps

    def answered(group: pa.Table) -> pa.Table:
        ids = _joined(group["ids"], "<i8")
        keys = _joined(group["keys"], "<u8")
        if not len(keys):  # what a task has told its documents itself
            return pa.table({"doc": pa.array(ids), "hashes": group["hashes"].combine_chunks()})
        order, first, run = _groups(keys)
        size = np.diff(np.append(first, len(keys)))
        k, d = keys[order], ids[order]
        # an entry without an answer stands for two documents; two entries with one id are one document
        low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
        again = ((size > 1) & (low != high))[run] & (d != NOBODY)
        rows = list(told(k[again], d[again]))
        return pa.table({"doc": pa.array([np.frombuffer(r[2], "<i8")[0] for r in rows], pa.int64()), "hashes": pa.array([r[3] for r in rows], pa.binary())})

    sent = docs.mapInArrow(read, "bucket long, keys binary, ids binary, hashes binary")
    return sent.groupBy("bucket").applyInArrow(answered, "doc long, hashes binary")


def pieces(docs: DataFrame, found: DataFrame, width: int, buckets: int) -> DataFrame:
    """Pieces of the text around recurring minimizers: bucket, digest (two numbers), doc, start, starts (how many strings begin in it), data (null if the task has sent it)."""
    hashes = found.groupBy("doc").agg(F.collect_list("hashes").alias("hashes"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches(parts, "text", 1 << 20):
            data, sizes = laid_out(batch.column("text"))
            text, docs = data.tobytes(), batch.column("doc").to_pylist()
            ends = np.cumsum(sizes)
            _, (first, end), lows = minimizers(data, width, sizes)
            whose = np.searchsorted(ends, first, "right")
            # hashes of all documents in one sorted array: each document's are mixed with a number of its own
            own = mix(np.arange(1, len(sizes) + 1, dtype=np.uint64))
            known = [np.frombuffer(b"".join(x.as_py()), "<u8") ^ own[i] for i, x in enumerate(batch.column("hashes"))]
            recur = np.sort(np.concatenate(known))
            asked = lows[first] ^ own[whose]
            # a string can recur only if its minimizer does
            hit = recur[np.minimum(np.searchsorted(recur, asked), len(recur) - 1)] == asked
            cut = first[hit & ((lows[first] >> np.uint64(8)) % np.uint64(CUT_EVERY) == 0)].tolist()
            first, end, whose = first[hit], end[hit], whose[hit]
            joins = np.zeros(len(first) + 1, bool)
            joins[1:-1] = (first[1:] == end[:-1]) & (whose[1:] == whose[:-1])
            out: list[tuple[int, int, int, int, int, int, bytes | None]] = []
            k = 0
            for begin, stretch, i in zip(first[~joins[:-1]].tolist(), end[~joins[1:]].tolist(), whose[~joins[:-1]].tolist(), strict=True):
                base = int(ends[i] - sizes[i])
                while begin < stretch:
                    while k < len(cut) and cut[k] < begin + LEAST:
                        k += 1
                    stop = min(cut[k] if k < len(cut) else stretch, begin + MOST, stretch)
                    piece = text[begin:stop + width - 1]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    high = int.from_bytes(digest[:8], "little", signed=True)
                    out.append((high % buckets, high, int.from_bytes(digest[8:], "little", signed=True), docs[i], begin - base, stop - begin, None if digest in sent else piece))
                    sent.add(digest)
                    begin = stop
            if len(sent) > REMEMBERED:
                sent.clear()
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.binary()], strict=True)], names=["bucket", "d0", "d1", "doc", "start", "starts", "data"])

    return docs.join(hashes, "doc").select("doc", "text", "hashes").mapInArrow(run, "bucket long, d0 long, d1 long, doc long, start long, starts long, data binary")


FOUND = "doc long, piece long, at long, value long"


def distinct_pieces(cut: DataFrame) -> DataFrame:
    """What is known of every piece: WHOLE (piece: its start, value: its starts) where a smaller id has it, too, or PLACE (value: its start) in the smallest id, once with its data."""

    def chosen(group: pa.Table) -> pa.Table:
        d0, d1, doc, start, starts = (group[c].to_numpy().astype(np.int64) for c in ("d0", "d1", "doc", "start", "starts"))
        data = group["data"].combine_chunks()
        order = np.lexsort((start, doc, d1, d0))
        d0, d1, doc, start, starts = (x[order] for x in (d0, d1, doc, start, starts))
        new = np.ones(len(order), bool)
        new[1:] = (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1])
        first = np.flatnonzero(new)
        whole = doc > doc[first][np.cumsum(new) - 1]
        given = np.where(data.is_valid().to_numpy(zero_copy_only=False)[order], order, -1)
        take = np.full(len(order), -1)
        take[first] = np.maximum.reduceat(given, first)
        return pa.table({
            "doc": doc, "piece": np.where(whole, start, d0), "at": np.where(whole, WHOLE, PLACE), "value": np.where(whole, starts, start),
            "data": data.take(pa.array(take, mask=take < 0)),
        })

    return cut.groupBy("bucket").applyInArrow(chosen, f"{FOUND}, data binary")


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows of bytes (a multiple of eight), and how many bytes each has in common with the one sorted before it."""
    letters = keys.view(">u8")
    order = np.lexsort([letters[:, k].astype(np.uint64) for k in range(letters.shape[1])][::-1])
    ranked = keys[order]
    common = np.zeros(len(order), np.int64)
    differ = ranked[1:] != ranked[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return order, common


def _beside(text: np.ndarray, begin: np.ndarray, step: int, room: np.ndarray, most: int) -> np.ndarray:
    """The bytes from `begin` on by `step`, `room` of them, in rows of at least `most` bytes filled up with zeros."""
    out = np.zeros((len(begin), -(-most // 8) * 8), np.uint8)
    for k in range(most):
        has = room > k
        out[has, k] = text[begin[has] + step * k]
    return out


def suffix_matches(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """A row for every minimizer with strings that also begin in a piece of a smaller id: doc, piece, at, value (bit s: the string that begins s bytes before it); `texts` has doc, piece, data."""
    span = width - GRAM + 1

    def sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, "data", 1 << 19):
            data, sizes = laid_out(batch.column("data"))
            at, (first, end), lows = minimizers(data, width, sizes)
            ends = np.cumsum(sizes)
            which = np.searchsorted(ends, first, "right")
            bucket = (lows[first] >> np.uint64(20)) % np.uint64(buckets)
            order, begin, _ = _groups(bucket)
            bounds = _bounds(begin, len(order))
            doc, piece = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[which[order]] for c in ("doc", "piece"))
            size = (end - first + width - 1)[order]
            upto = np.concatenate([[0], np.cumsum(size)])
            text = data[spans(first[order], size)]
            before, count, off = (at - first)[order], (end - first)[order], (at - ends[which] + sizes[which])[order]
            yield pa.record_batch({
                "bucket": pa.array([int(bucket[order[b]]) for b, _ in bounds], pa.int64()),
                "doc": pa.array([_squeezed(doc[b:e]) for b, e in bounds], pa.binary()),
                "piece": pa.array([_packed(piece[b:e], "<i8") for b, e in bounds], pa.binary()),
                "at": pa.array([_packed(off[b:e], "<i4") for b, e in bounds], pa.binary()),
                "before": pa.array([_packed(before[b:e], "u1") for b, e in bounds], pa.binary()),
                "count": pa.array([_packed(count[b:e], "u1") for b, e in bounds], pa.binary()),
                "text": pa.array([text[upto[b]:upto[e]].tobytes() for b, e in bounds], pa.binary()),
            })

    def judged(group: pa.Table) -> pa.Table:
        doc, piece, at = _numbers(group["doc"]), _joined(group["piece"], "<i8"), _joined(group["at"], "<i4")
        before, count = (_joined(group[c], "u1").astype(np.int64) for c in ("before", "count"))
        text = _joined(group["text"], "u1")
        size = count + width - 1
        place = np.cumsum(size) - size + before
        # suffixes from the minimizers on; where all with a gram are in one document, nothing recurs
        suffixes = _beside(text, place, 1, size - before, width)
        order, common = _names(suffixes)
        new = common < GRAM
        new[:1] = True
        first = np.flatnonzero(new)
        if len(first):
            low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            shared = (low != high)[np.cumsum(new) - 1]
            # what two entries have in common is the least on the way, and groups go whole
            order, common = order[shared], common[shared]
        doc, piece, at, before, count, place = (x[order] for x in (doc, piece, at, before, count, place))
        # prefixes in front of them, reversed
        back, alike = _names(_beside(text, place - 1, -1, before, span - 1))
        found = np.zeros(len(order), np.int64)
        name = np.empty(len(order), np.int64)
        for s in range(span):
            has = np.flatnonzero((before - count < s) & (s <= before))
            if len(has) < 2:
                continue
            name[back] = np.cumsum(alike < s)
            key = (np.cumsum(common < width - s)[has] << np.int64(32)) | name[has]
            rank, first, run = _groups(key)
            whose = doc[has][rank]
            later = np.minimum.reduceat(whose, first)[run] < whose
            found[has[rank[later]]] |= np.int64(1 << s)
        some = found != 0
        return pa.table({"doc": doc[some], "piece": piece[some], "at": at[some].astype(np.int64), "value": found[some]})

    sent = texts.mapInArrow(sampled, "bucket long, doc binary, piece binary, at binary, before binary, count binary, text binary")
    return sent.groupBy("bucket").applyInArrow(judged, FOUND)


def removed_runs(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What to remove, several rows a document, as `distinct_pieces` and `suffix_matches` tell: doc, piece, at, value."""
    spark = docs.sparkSession
    buckets = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    found = stored(recurring(texts, buckets, width), "recurring")
    released(spark)
    # written before they are dealt, so that the shuffle of the texts is gone by then
    cut = stored(pieces(texts, found, width, buckets), "cut")
    dropped(found)
    released(spark)
    known = stored(distinct_pieces(cut), "pieces")
    dropped(cut)
    released(spark)
    matches = stored(suffix_matches(known.filter("data IS NOT NULL").select("doc", "piece", "data"), buckets, width), "matches")
    released(spark)
    return known.drop("data").unionByName(matches)


def string_starts(piece: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings to remove from a document begin, and where they end; neighbours of a whole piece as one."""
    whole, place, match = at == WHOLE, at == PLACE, at >= 0
    starts, ends = piece[whole], piece[whole] + value[whole] + width - 1
    if match.any():
        order = np.argsort(piece[place], kind="stable")
        names, where = piece[place][order], value[place][order]
        begin, end = (np.searchsorted(names, piece[match], side) for side in ("left", "right"))
        off = where[spans(begin, end - begin)] + np.repeat(at[match], end - begin)
        i, s = np.nonzero((np.repeat(value[match], end - begin)[:, None] >> np.arange(width - GRAM + 1)) & 1)
        starts, ends = np.concatenate([starts, off[i] - s]), np.concatenate([ends, off[i] - s + width])
    return starts, ends


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Takes every byte that a recurring string of `width` bytes covers out of the texts, where a smaller id has it too.

    Strings are judged on the input texts as UTF-8 bytes and never cross
    documents.  Returns all columns of `docs`, then n_bytes, n_removed,
    n_spans (maximal removed runs; long) and kept_bytes (binary); with `as_text`
    kept_text (string) in its place, without bytes of characters that lost
    others of theirs.  Null and empty texts have zeros and nothing kept.  Rows with a null id lose nothing and cost others
    nothing; rows of one id are one document of several texts, which lose what
    any of them holds at the same place.  Ids must be whole numbers.  Columns of
    `docs` with the new names are replaced.
    """
    last = "kept_text" if as_text else "kept_bytes"
    docs = docs.drop("n_bytes", "n_removed", "n_spans", last)
    runs = removed_runs(docs, width, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("piece", "at", "value")).alias("_runs"))
    joined = docs.join(runs.withColumnRenamed("doc", "_doc"), F.col(id_col).cast("long") == F.col("_doc"), "left").drop("_doc")
    names = [*docs.columns, "n_bytes", "n_removed", "n_spans", last]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, text_col, 1 << 20):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            rows = batch.column("_runs")
            ends_of = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
            columns = [x.to_numpy(zero_copy_only=False) for x in rows.flatten().flatten()]
            for text, b, e in zip(pc.cast(batch.column(text_col), pa.binary()), [0, *ends_of[:-1].tolist()], ends_of.tolist(), strict=True):
                text = text.as_py() or b""
                n, gone, spans_, rest = len(text), 0, 0, text
                change = np.zeros(n + 1 if b < e else 0, np.int32)
                if b < e:
                    starts, ends = string_starts(*(x[b:e] for x in columns), width)
                    np.add.at(change, starts[ends <= n], 1)
                    np.add.at(change, ends[ends <= n], -1)
                if change.any():
                    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0])
                    gone = int(covered.sum())
                    spans_ = int((covered[1:] & ~covered[:-1]).sum())
                    rest = np.frombuffer(text, np.uint8)[~covered[1:]].tobytes()
                n_bytes.append(n)
                n_removed.append(gone)
                n_spans.append(spans_)
                kept.append(rest.decode(errors="ignore") if as_text else rest)
            yield pa.record_batch([
                *(batch.column(c) for c in docs_columns), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string() if as_text else pa.binary()),
            ], names=names)

    docs_columns = docs.columns
    schema = docs.select("*", *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.lit("" if as_text else b"").alias(last)).schema
    return joined.mapInArrow(run, schema)
