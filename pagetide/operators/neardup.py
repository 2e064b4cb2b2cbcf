"""Near-duplicate pairs and greedy groups by Hamming distance of signatures.

Equal signatures are folded into one node first, so a text that fills a third
of the table is one row here.  Two signatures at distance t or less agree on at
least B - t of B bit blocks; every choice of B - t blocks gives one equi-join
key, which finds all such pairs without comparing everything to everything.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import hashing as X
from pagetide.operators.running import slices
from pagetide.sources.scratch import cut, kept

BITS = 64
#: To write and sort one row of a key costs as much as so many tests of two signatures.
ROW_TESTS = 100
#: Nodes of the shortest run of the grouping pass, and how many such runs it takes first.
RUN_NODES, FIRST_RUN = 8192, 4
#: Pairs of a run that are always taken; beyond them, SHARE for each node.  One node in SHARE tells how many there are.
MOST_PAIRS, SHARE = 1 << 25, 64


def signature_nodes(signatures: DataFrame, key: str = "doc_id", signature: str = "simhash") -> DataFrame:
    """(signature, lead_id, copies): each distinct signature with its first id."""
    return signatures.groupBy(F.col(signature).alias("signature")).agg(
        F.min(key).alias("lead_id"), F.count(F.lit(1)).alias("copies")
    )


def choose_blocks(nodes: int, threshold: int) -> int:
    """Number of blocks with the least expected work for so many signatures.

    Rows written are nodes x keys; for evenly spread signatures the pairs
    tested are keys x nodes^2 / 2^(key width + 1).
    """
    def work(blocks: int) -> float:
        keys = comb(blocks, blocks - threshold)
        width = BITS * (blocks - threshold) / blocks
        return keys * (nodes + nodes * nodes / 2 ** (width + 1))

    return min(range(threshold + 1, threshold + 8), key=work)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _keyed(nodes: DataFrame, blocks: int, threshold: int) -> DataFrame:
    """One row per node and block choice: choice, value, and its gap blocks.

    `gaps` marks the blocks left out although a later one was taken; a pair is
    reported only by the choice whose gaps all differ, hence exactly once.
    """
    masks = _block_masks(blocks)
    entries = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - threshold)):
        mask = sum(masks[b] for b in chosen)
        gaps = sum(1 << b for b in range(max(chosen)) if b not in chosen)
        entries.append(F.struct(
            F.lit(number).alias("choice"),
            F.col("signature").bitwiseAND(F.lit(_signed(mask))).alias("value"),
            F.lit(gaps).alias("gaps"),
        ))
    return nodes.select("*", F.inline(F.array(*entries)))


def _reported_once(difference: Column, gaps: Column, blocks: int) -> Column:
    once = F.lit(True)
    for b, mask in enumerate(_block_masks(blocks)):
        is_gap = gaps.bitwiseAND(F.lit(1 << b)) != 0
        once = once & (~is_gap | (difference.bitwiseAND(F.lit(_signed(mask))) != 0))
    return once


def bucket_work(nodes: DataFrame, blocks: int, threshold: int) -> tuple[int, int]:
    """Rows that the keys are written in, and pairs of nodes that share a key."""
    sizes = _keyed(nodes, blocks, threshold).groupBy("choice", "value").count()
    pairs = F.coalesce(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2), F.lit(0.0))
    rows, tested = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), pairs).first()
    return rows, int(tested)


def fit_blocks(nodes: DataFrame, threshold: int) -> int:
    """Number of blocks whose keys make the least work for these signatures.

    Starts from the number that suits evenly spread signatures and widens the
    keys, four steps at most, while that leaves out more tests than its rows cost.
    """
    blocks = choose_blocks(nodes.count(), threshold)
    rows, tested = bucket_work(nodes, blocks, threshold)
    while blocks < threshold + 4:
        # Writing the wider keys alone may cost more than all tests do now.
        more = rows * comb(blocks + 1, threshold) // comb(blocks, threshold)
        if ROW_TESTS * more >= ROW_TESTS * rows + tested:
            break
        wider, fewer = bucket_work(nodes, blocks + 1, threshold)
        if ROW_TESTS * wider + fewer >= ROW_TESTS * rows + tested:
            break
        blocks, rows, tested = blocks + 1, wider, fewer
    return blocks


def full_buckets(nodes: DataFrame, blocks: int, threshold: int, dense_bucket: int) -> DataFrame:
    """(choice, value, tiles): keys that more than `dense_bucket` nodes share, and the parts to deal them into."""
    sizes = _keyed(nodes.select("signature"), blocks, threshold).groupBy("choice", "value").count()
    return kept(sizes.filter(F.col("count") > dense_bucket).select(
        "choice", "value", F.ceil(F.col("count") / dense_bucket).cast("int").alias("tiles")
    ), "buckets")


def _candidates(left: DataFrame, right: DataFrame, blocks: int, threshold: int, full: DataFrame, close: Column) -> DataFrame:
    """Rows a and b of `left` and `right` that share a key and fulfil `close`.

    A full bucket is dealt over several tasks: each row of `right` goes to one
    part of it, each of `left` to all parts.
    """
    def dealt(rows: DataFrame, parts: Column) -> DataFrame:
        return _keyed(rows, blocks, threshold).join(full, ["choice", "value"], "left").withColumn("part", parts).drop("tiles")

    tiles = F.coalesce("tiles", F.lit(1))
    a = dealt(left, F.explode(F.sequence(F.lit(0), tiles - 1))).alias("a")
    b = dealt(right, F.pmod(F.hash("signature"), tiles)).alias("b")
    same = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.part") == F.col("b.part"))
    return a.join(b, same & close)


def near_pairs(
    nodes: DataFrame, threshold: int = 5, blocks: int | None = None, dense_bucket: int = 512, full: DataFrame | None = None
) -> DataFrame:
    """(lead_a, lead_b, distance) of distinct signatures, lead_a < lead_b."""
    nodes = nodes.select("lead_id", "signature")
    if blocks is None:
        nodes = cut(nodes)
        blocks = fit_blocks(nodes, threshold)
    if full is None:
        full = full_buckets(nodes, blocks, threshold, dense_bucket)
    difference = F.col("a.signature").bitwiseXOR(F.col("b.signature"))
    close = (
        (F.col("a.lead_id") < F.col("b.lead_id"))
        & (F.bit_count(difference) <= threshold)
        & _reported_once(difference, F.col("a.gaps"), blocks)
    )
    return _candidates(nodes, nodes, blocks, threshold, full, close).select(
        F.col("a.lead_id").alias("lead_a"), F.col("b.lead_id").alias("lead_b"), F.bit_count(difference).alias("distance")
    )


def _members_of_pairs(pairs: DataFrame) -> DataFrame:
    """(lead_id) of the nodes that follow another one, by rounds over the pairs.

    A node that is never second in a pair leads, and its partners follow it;
    both leave, which lets others lead in the next round.
    """
    members = pairs.limit(0).select(F.col("lead_b").alias("lead_id"))
    while not pairs.isEmpty():
        second = pairs.select(F.col("lead_b").alias("lead_a")).distinct()
        of_leaders = pairs.join(second, "lead_a", "left_anti")
        settled = cut(of_leaders.select(F.col("lead_b").alias("lead_id")).distinct())
        members = members.unionByName(settled)
        pairs = cut(
            pairs.join(second, "lead_a", "left_semi")
            .join(settled.withColumnRenamed("lead_id", "lead_a"), "lead_a", "left_anti")
            .join(settled.withColumnRenamed("lead_id", "lead_b"), "lead_b", "left_anti")
        )
    return members


def _expected_pairs(nodes: DataFrame, blocks: int, threshold: int, full: DataFrame) -> int:
    """About how many pairs of nodes are near: those of one node in `SHARE` are counted."""
    some = nodes.filter(F.pmod(F.xxhash64("signature"), F.lit(SHARE)) == 0)
    difference = F.col("a.signature").bitwiseXOR(F.col("b.signature"))
    close = (F.bit_count(difference) <= threshold) & (difference != 0) & _reported_once(difference, F.col("a.gaps"), blocks)
    return _candidates(some, nodes, blocks, threshold, full, close).count() * SHARE // 2


def _followers(leaders: DataFrame, nodes: DataFrame, blocks: int, threshold: int, full: DataFrame) -> DataFrame:
    """(signature, lead_id, group_id, distance): nodes near a leader that is not behind them, with the first such one."""
    distance = X.hamming(F.col("a.signature"), F.col("b.signature"))
    close = (F.col("a.lead_id") <= F.col("b.lead_id")) & (distance <= threshold)
    first = F.min(F.struct(F.col("a.lead_id").alias("group_id"), distance.alias("distance"))).alias("g")
    near = _candidates(leaders, nodes, blocks, threshold, full, close)
    return near.groupBy(F.col("b.signature").alias("signature"), F.col("b.lead_id").alias("lead_id")).agg(first).select("signature", "lead_id", "g.*")


def grouped_nodes(nodes: DataFrame, threshold: int, blocks: int, dense_bucket: int) -> DataFrame:
    """(signature, lead_id, group_id, distance) of the nodes, as a pass in id order groups them.

    The ids are taken in runs, each as long as all before it.  What is near a
    leader is settled at once, in later runs too.  So the open nodes of a run
    have few neighbours among themselves, however many they had at the start,
    and those pairs tell who leads.  A run that still has many is halved.
    """
    number = max(1, -(-nodes.count() // RUN_NODES))
    full = full_buckets(nodes, blocks, threshold, dense_bucket)
    rest = slices(nodes.filter("signature IS NOT NULL").select("lead_id", "signature"), [], ["lead_id"], number).withColumn("_settled", F.lit(False))
    done, size, groups = 0, FIRST_RUN, []
    while done < number:
        run = rest.filter(~F.col("_settled") & (F.col("_slice") < done + size)).select("lead_id", "signature")
        if size > 1 and _expected_pairs(run, blocks, threshold, full) > MOST_PAIRS + SHARE * run.count():
            size //= 2
            continue
        members = _members_of_pairs(cut(near_pairs(run, threshold, blocks, full=full)))
        leaders = cut(run.join(members, "lead_id", "left_anti"))
        found = cut(_followers(leaders, rest.select("lead_id", "signature"), blocks, threshold, full))
        groups.append(found)
        done += size
        size = done
        if done < number:
            followed = found.select("lead_id", F.lit(True).alias("_follows")).distinct()
            rest = cut(
                rest.join(found.select("signature"), "signature", "left_anti").join(followed, "lead_id", "left")
                .select("lead_id", "signature", "_slice", (F.col("_settled") | F.col("_follows").isNotNull()).alias("_settled"))
            )
    return reduce(DataFrame.unionByName, groups)


def greedy_leaders(nodes: DataFrame, threshold: int = 5, blocks: int | None = None, dense_bucket: int = 512) -> DataFrame:
    """(lead_id, signature) of the nodes a pass in id order would let lead."""
    nodes = cut(nodes.select("lead_id", "signature"))
    blocks = blocks or fit_blocks(nodes, threshold)
    members = grouped_nodes(nodes, threshold, blocks, dense_bucket).filter("group_id < lead_id").select("lead_id")
    return nodes.join(members, "lead_id", "left_anti")


def greedy_groups(
    signatures: DataFrame,
    key: str = "doc_id",
    signature: str = "simhash",
    threshold: int = 5,
    blocks: int | None = None,
    dense_bucket: int = 512,
) -> DataFrame:
    """(key, group_id, distance): every row of a group of two or more.

    Same groups as a pass over the rows in key order in which the first
    ungrouped row takes all later ungrouped rows within the threshold:
    `group_id` is the key of that first row.  A row joins the earliest leader
    near it, which need not be the nearest one.
    """
    signatures = cut(signatures.select(F.col(key).alias("_key"), F.col(signature).alias("signature")))
    nodes = cut(signature_nodes(signatures, "_key", "signature"))
    blocks = blocks or fit_blocks(nodes, threshold)
    joined = grouped_nodes(nodes, threshold, blocks, dense_bucket).drop("lead_id")
    copies = nodes.select("signature", "copies")
    sized = joined.join(copies, "signature")
    large = sized.groupBy("group_id").agg(F.sum("copies").alias("n")).filter("n > 1").select("group_id")
    members = sized.join(large, "group_id", "left_semi").select("signature", "group_id", "distance")
    return signatures.join(members, "signature").select(F.col("_key").alias(key), "group_id", "distance")
