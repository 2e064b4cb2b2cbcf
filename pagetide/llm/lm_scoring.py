"""Language-model scoring by context-tree weighting over bytes, with a word model beside it.

Each byte is eight binary decisions.  A decision has a context tree of its own:
its node at depth d is the last d bytes with the bits already known.  Every
node keeps a Krichevsky-Trofimov estimate of its two counts, and the weighted
probability of a node is half its own estimate and half the product over the
contexts one byte longer.  Trees are built from counts of byte (depth + 1)-grams
of all training texts, from the deepest level up: the nodes of one context of
`SPLIT` bytes by one task, those of shorter contexts by Spark.

For scoring, a node's prediction mixes the estimates along its path by the
weights of the trained tree; the deepest context seen predicts.  Every gram of
the texts, learnt or not, gets its log probability from the whole trees once.
The frequent grams' go to the tasks that read texts, as a cache of a fixed
bound; the others are joined with the grams of the texts they stand in.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.shared import batches, lower_ascii, stored

DEPTH = 5
#: Nodes with so many context bytes and more are built in parts, by these bytes; those above are bounded by the alphabet.
SPLIT = 3
#: Grams of a part, about; its nodes are eight times as many, and several arrays of them are held at a time.
PART = 1 << 16
#: Grams with log probabilities that go to every task, at most; the others are joined.
CACHED = 1 << 20
#: Words with counts that go to every task, at most; the others are joined.
DICTIONARY = 1 << 17
#: Entries a task gathers before it hands them on, and the rows it hands on at a time.
GATHERED, HANDED = 1 << 20, 1 << 17


def text_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the `depth` bytes before it as one number, all texts in turn (zeros before a text); sizes of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(bytes(depth) + t for t in texts), np.uint8)
    grams = np.zeros(max(len(data) - depth, 0), np.uint64)
    for k in range(depth + 1):
        grams = (grams << np.uint64(8)) | data[k:len(data) - depth + k]
    real = np.ones(len(data), bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    for k in range(depth):
        real[starts + k] = False
    return grams[real[depth:]], sizes


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def corpus_counts(texts: DataFrame, depth: int) -> DataFrame:
    """Counts of byte grams, and of words where `learn` holds, over all rows of `text`: gram (long) or word (binary; empty: end of a text), n.

    A gram is doubled, with one added where it stands in a text to learn.
    Partial counts per task; add them up by key.
    """

    def rows(grams: np.ndarray, words: list[bytes], n: np.ndarray | list[int]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), HANDED):
            own, met = grams[at:at + HANDED].astype(np.int64), words[at:at + HANDED]
            yield pa.record_batch([
                pa.concat_arrays([pa.array(own), pa.nulls(len(met), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(own), pa.binary()), pa.array(met, pa.binary())]), pa.array(n[at:at + HANDED], pa.int64()),
            ], names=["gram", "word", "n"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        words: Counter[bytes] = Counter()
        for batch in batches(parts, "text", 1 << 20):
            found = [t.as_py() or b"" for t in pc.cast(batch.column("text"), pa.binary())]
            learn = batch.column("learn").to_pylist()
            if any(learn):
                words[b""] += sum(learn)
            for text in (t for t, own in zip(found, learn, strict=True) if own):
                words.update(text.split())
            grams, sizes = text_grams(found, depth)
            if len(grams):
                grams = (grams << np.uint64(1)) | np.repeat(np.array(learn, np.uint64), sizes)
                grams.sort()
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                keys.append(grams[first])
                counts.append(np.diff(np.append(first, len(grams))))
                held += len(first)
            if held > GATHERED:
                keys, counts = ([x] for x in _merged(keys, counts))
                held = len(keys[0])
                if held > GATHERED // 2:
                    yield from rows(keys[0], [], counts[0])
                    keys, counts, held = [], [], 0
            if len(words) > GATHERED // 4:
                yield from rows(np.zeros(0, np.int64), list(words), list(words.values()))
                words = Counter()
        if keys:
            key, count = _merged(keys, counts)
            yield from rows(key, [], count)
        if words:
            yield from rows(np.zeros(0, np.int64), list(words), list(words.values()))

    return texts.mapInArrow(run, "gram long, word binary, n long")


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 0.5, to about 1e-11 (Stirling's series after eight steps up)."""
    x, rise = x.cast("double"), F.lit(0.0)
    for k in range(8):
        rise = rise + F.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - rise


def tree_levels(rows: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes of the context trees, by depth from 0 to `depth`: key (context bytes, then the known bits behind a leading one), n0, n1, stop.

    `rows` has key, n0, n1 and the weighted probability `below` of the nodes
    one byte deeper.  `stop` is the share of a node's own estimate in its
    weighted probability.
    """
    levels: list[DataFrame] = []
    for d in range(depth, -1, -1):
        summed = rows.groupBy(F.col("key").bitwiseAND(_mask(d)).alias("key")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
        half = F.lit(0.5)
        own = log_gamma(F.col("n0") + half) + log_gamma(F.col("n1") + half) - log_gamma(F.col("n0") + F.col("n1") + 1) - math.log(math.pi)
        level = summed.select("key", "n0", "n1", own.alias("own"), "below")
        top = F.greatest("own", "below")
        both = top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("below") - top)) - math.log(2)
        level = stored(level.select("key", "n0", "n1", both.alias("weighted"), F.exp(F.col("own") - math.log(2) - both).alias("stop")), f"ctw-{d}")
        levels.insert(0, level)
        rows = level.select("key", "n0", "n1", F.col("weighted").alias("below"))
    return levels


def _mask(depth: int) -> int:
    return (1 << 8 * (depth + 1)) - 1


def _log_gammas(x: np.ndarray) -> np.ndarray:
    """`log_gamma` of an array."""
    x = x.astype(float)
    rise = x.copy()
    for k in range(1, 8):  # in place: eight arrays of all nodes would be the most a task holds
        rise *= x + k
    np.log(rise, out=rise)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - rise


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *(np.add.reduceat(v[order], first) for v in values)


def part_levels(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Nodes with `top` to `depth` context bytes over all grams of some contexts of `top` bytes: (key, n0, n1, stop) by depth, and the first ones' weighted probabilities."""
    byte = grams & np.uint64(0xFF)
    key = np.concatenate([grams - byte + (byte >> np.uint64(8 - k)) + np.uint64(1 << k) for k in range(8)])
    n1 = np.concatenate([n * ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64) for k in range(8)])
    n0, below = np.tile(n, 8) - n1, np.zeros(len(key))
    levels: list[tuple[np.ndarray, ...]] = []
    for d in range(depth, top - 1, -1):
        key, n0, n1, below = _summed(key & np.uint64(_mask(d)), n0, n1, below)
        own = _log_gammas(n0 + 0.5) + _log_gammas(n1 + 0.5) - _log_gammas(n0 + n1 + 1) - math.log(math.pi)
        both = own if d == depth else np.logaddexp(own, below) - math.log(2)
        levels.insert(0, (key, n0, n1, np.ones(len(key)) if d == depth else np.exp(own - math.log(2) - both)))
        below = both
    return levels, below


def predictions(levels: list[tuple[np.ndarray, ...]], first: int = 0, above: tuple[np.ndarray, ...] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, ...] | None]:
    """Keys (sorted) and probabilities of a one, by depth from `first`; and what the next depth needs as `above`."""
    out = []
    for d, (key, n0, n1, stop) in enumerate(levels, first):
        estimate = (n1 + 0.5) / (n0 + n1 + 1)
        if above is None:
            mixed, rest = np.zeros(len(key)), np.ones(len(key))
        else:
            at = np.searchsorted(above[0], key & np.uint64(_mask(d - 1)))
            _, mixed, rest, stopped, est = (x[at] for x in above)
            mixed, rest = mixed + rest * stopped * est, rest * (1 - stopped)
        out.append((key, mixed + rest * estimate))
        above = key, mixed, rest, stop, estimate
    return out, above


def gram_scores(grams: DataFrame, depth: int, parts: int) -> DataFrame:
    """log10 probability of the last byte of every gram after the others: gram, m, log.

    `grams` has gram, n (count in training texts; 0: not learnt) and m, one
    row per gram.  The trees hold all grams with a count, whatever it is.
    """
    spark = grams.sparkSession
    top = min(SPLIT, depth)
    dealt = grams.withColumn("part", F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND((1 << 8 * top) - 1)), F.lit(parts)).cast("int"))

    def learnt(part: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]], np.ndarray]:
        gram, n = part["gram"].to_numpy().astype(np.uint64), part["n"].to_numpy()
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        return order, *(part_levels(gram[n > 0], n[n > 0], depth, top) if n.any() else ([], np.zeros(0)))

    def tops(part: pa.Table) -> pa.Table:
        _, levels, below = learnt(part)
        key, n0, n1, below = _summed(levels[0][0] & np.uint64(_mask(top - 1)), *levels[0][1:3], below)
        return pa.table({"key": key.astype(np.int64), "n0": n0, "n1": n1, "below": below})

    upper = []
    if top:
        for level in tree_levels(dealt.filter("n > 0").groupBy("part").applyInArrow(tops, "key long, n0 long, n1 long, below double"), top - 1):
            found = level.select("key", "n0", "n1", "stop").toArrow()
            key = found["key"].to_numpy().astype(np.uint64)
            order = np.argsort(key)
            upper.append((key[order], *(found[c].to_numpy()[order] for c in ("n0", "n1", "stop"))))
    shared = spark.sparkContext.broadcast(predictions(upper))

    def score(part: pa.Table) -> pa.Table:
        order, levels, _ = learnt(part)
        nodes, above = shared.value
        part = part.take(pa.array(order))
        below, _ = predictions(levels, top, above)
        del levels
        logs = Scorer([*nodes, *below])._compute(part["gram"].to_numpy().astype(np.uint64))
        return pa.table({"gram": part["gram"], "m": part["m"], "log": logs})

    return dealt.groupBy("part").applyInArrow(score, "gram long, m long, log double")


def _least(sizes: list, most: int) -> int:
    """The smallest power of two, from (k, v) in falling order, above which at most `most` entries are."""
    held, least = 0, 63
    for r in sizes:
        held += r["v"]
        if held > most:
            break
        least = r["k"]
    return least


class Scorer:
    """log10 probability of bytes in their contexts, with a cache of a fixed number of grams."""

    SLOTS = 20

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = levels
        self.cached = np.zeros(1 << self.SLOTS, np.uint64)
        self.value = np.zeros(1 << self.SLOTS)

    def _compute(self, grams: np.ndarray) -> np.ndarray:
        total = np.zeros(len(grams))
        byte = grams & np.uint64(0xFF)
        for k in range(8):
            key = grams - byte + (byte >> np.uint64(8 - k)) + np.uint64(1 << k)
            one = np.full(len(grams), 0.5)
            open_ = np.arange(len(grams))
            for d in range(len(self.levels) - 1, -1, -1):
                keys, p = self.levels[d]
                if not len(keys):
                    continue
                wanted = key[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                one[open_[hit]] = p[at[hit]]
                open_ = open_[~hit]
                if not len(open_):
                    break
            bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total

    def values(self, grams: np.ndarray) -> np.ndarray:
        slot = (((grams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.value[slot]
        missed = np.flatnonzero(self.cached[slot] != grams + np.uint64(1))
        if len(missed):
            new, back = np.unique(grams[missed], return_inverse=True)
            known = self._compute(new)
            out[missed] = known[back]
            at = (((new + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            # of two grams with one slot the last one stays, in both arrays
            self.cached[at], self.value[at] = new + np.uint64(1), known
        return out


class Known(Scorer):
    """Looks up grams whose log10 probabilities are known (sorted by gram); not a number for others."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        super().__init__([])
        self.grams, self.logs = grams, logs

    def _compute(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.full(len(grams), np.nan)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.logs[at], np.nan)

    def scores(self, texts: list[bytes], depth: int) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """Sum of the known grams of each text; its other grams, and how often each stands in it."""
        grams, sizes = text_grams(texts, depth)
        values = self.values(grams)
        ends = np.cumsum(sizes)
        other = np.flatnonzero(np.isnan(values))
        values[other] = 0
        upto = np.concatenate([[0.0], np.cumsum(values)])
        row, gram = np.searchsorted(ends, other, "right"), grams[other]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])[:len(row)]
        first = np.flatnonzero(new)
        offsets = pa.array(np.searchsorted(row[first], np.arange(len(texts) + 1)), pa.int32())
        rest = pa.array(gram[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(row))), pa.int64())
        return upto[ends] - upto[ends - sizes], *(pa.ListArray.from_arrays(offsets, x) for x in rest)


def score_texts(docs: DataFrame, learn: Column, depth: int = DEPTH, cached: int = CACHED, dictionary: int = DICTIONARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text by models of the rows where `learn` (a condition on the id) holds.

    Texts are lower-cased in A-Z.  Returns one row per input row: id, n_tokens
    (words and one end), n_known (tokens with a count), train_tokens, base_score
    (word model), score (log10 probability of the bytes by context-tree
    weighting), bits_per_byte (null for an empty text).  Null texts count as
    empty; rows with a null id are scored, and learnt from where `learn` is
    true for them.  More columns are ignored.

    All training rows are counted, and every context they hold predicts.  The
    frequent words' counts and the frequent grams' log probabilities go to the
    tasks (at most `dictionary` words and `cached` grams, by a power-of-two bound
    on the count); the tokens of the other words and the other grams are joined
    with theirs.
    """
    spark = docs.sparkSession
    read = docs.select(id_col, lower_ascii(F.col(text_col)).alias("text"))
    counts = stored(corpus_counts(docs.select(lower_ascii(F.col(text_col)).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")), depth), "counts")
    words = stored(counts.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "words")
    grams = stored(counts.filter("gram IS NOT NULL").groupBy(F.shiftright("gram", 1).alias("gram")).agg(
        F.sum(F.col("n") * F.col("gram").bitwiseAND(1)).alias("n"), F.sum("n").alias("m")), "grams")
    often = F.floor(F.log2("m")).cast("int")
    gram_sizes = sorted(grams.groupBy(often.alias("k")).agg(F.count("*").alias("v")).collect(), reverse=True)
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["v"] for r in gram_sizes) // PART)
    logs = stored(gram_scores(grams, depth, parts), "logs")
    least_gram = _least(gram_sizes, cached)
    kept = logs.filter(often >= least_gram).select("gram", "log").toArrow().sort_by("gram")

    power = F.floor(F.log2("c")).cast("int")
    sizes = sorted(words.groupBy(power.alias("k")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect(), reverse=True)
    n_all, n_distinct = sum(r["n"] for r in sizes), sum(r["v"] for r in sizes)
    least = _least(sizes, dictionary)
    frequent = words.filter(power >= least).toArrow()
    ends = words.filter(F.octet_length("word") == 0).collect()
    n_ends = ends[0]["c"] if ends else 0
    # with the logarithm of each count; the end has its own, wherever the bound lies
    end = math.log10(n_ends + 0.5) if n_ends else 0.0
    frequent = dict(zip(frequent["word"].to_pylist(), np.log10(frequent["c"].to_numpy() + 0.5).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((frequent, kept["gram"].to_numpy().astype(np.uint64), kept["log"].to_numpy()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, *logged = shared.value
        scorer = Known(*logged)
        for batch in batches(parts, "text", 1 << 20):
            texts = [t.as_py() or b"" for t in pc.cast(batch.column("text"), pa.binary())]
            n_tokens, n_known, found, rare, times = [], [], [], [], []
            for text in texts:
                tokens = text.split()
                other = Counter([t for t in tokens if t not in logs])
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(tokens) - other.total() + (n_ends > 0))
                found.append(math.fsum(logs[t] for t in tokens if t in logs) + end)
                rare.append(list(other))
                times.append(list(other.values()))
            score, others, repeats = scorer.scores(texts, depth)
            yield pa.record_batch([
                batch.column(id_col), batch.column("uid"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(found, pa.float64()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array(score, pa.float64()),
                pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), others, repeats,
            ], names=[id_col, "uid", "n_tokens", "n_known", "found", "n_bytes", "score", "rare", "times", "grams", "often"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stored(read.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        run, f"`{id_col}` {kind}, uid long, n_tokens long, n_known long, found double, n_bytes long, score double, rare array<binary>, times array<long>, grams array<long>, often array<long>"), "scored")
    tokens = scored.select("uid", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    joined = tokens.join(words.filter(power < least), "word").select(
        "uid", "times", (F.col("times") * F.log10(F.col("c") + 0.5)).alias("found"), F.lit(0.0).alias("score"))
    passed = scored.select("uid", F.inline(F.arrays_zip("grams", "often"))).withColumnRenamed("grams", "gram")
    joined = joined.unionByName(passed.join(logs.filter(often < least_gram), "gram").select(
        "uid", F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("found"), (F.col("often") * F.col("log")).alias("score")))
    others = joined.groupBy("uid").agg(F.sum("times").alias("more"), F.sum("found").alias("more_found"), F.sum("score").alias("more_score"))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    n_known = F.col("n_known") + F.coalesce("more", F.lit(0))
    base = (F.col("found") + F.coalesce("more_found", F.lit(0.0)) + (F.col("n_tokens") - n_known) * math.log10(0.5)
            - F.col("n_tokens") * math.log10(n_all + 0.5 * (n_distinct + 1)))
    return scored.drop("rare", "times", "grams", "often").join(others, "uid", "left").select(
        id_col, "n_tokens", n_known.alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
