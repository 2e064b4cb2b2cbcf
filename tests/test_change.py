"""Signatures, the change decision, near-duplicate groups."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagetide.functions import hashing as X
from pagetide.operators import fingerprints as P
from pagetide.operators import neardup as N
from pagetide.operators import text as T
from pagetide.plans import scan as S


def brute_simhash(text):
    tokens = re.findall(r"\w+", text.lower())
    if not tokens:
        return 0
    sums = [0] * 64
    for t in tokens:
        h = int(hashlib.sha256(t.encode()).hexdigest()[:16], 16)
        for i in range(64):
            sums[i] += 1 if h >> i & 1 else -1
    value = sum(1 << i for i in range(64) if sums[i] >= 0)
    return value - (1 << 64) if value >= 1 << 63 else value


TEXTS = ["", "   ", "...", "Call for papers", "call FOR papers!", "Größe 10 € naïve", "a a a b", "x" * 1000,
         " ".join(f"w{i}" for i in range(5000))]


def test_simhash_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "id int, text string")
    got = {r["id"]: r["simhash"] for r in P.simhash(df, ["id"], "text").collect()}
    assert got == {**{i: brute_simhash(t) for i, t in enumerate(TEXTS)}, 99: 0}


def test_similar_texts_are_near(evaluate, spark):
    near = "The conference deadline for all papers is March 15, 2026 in the city hall"
    rows = [(0, near), (1, near.replace("15", "16")), (2, "Registration is now open for attendees of the show")]
    sig = {r["id"]: r["simhash"] for r in P.simhash(spark.createDataFrame(rows, "id int, text string"), ["id"], "text").collect()}
    def dist(a, b):
        return evaluate(X.hamming(F.lit(sig[a]), F.lit(sig[b])))
    assert dist(0, 0) == 0 and dist(0, 1) < 20 < dist(0, 2) + 10
    assert evaluate(X.hamming(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))) == 64


def test_page_fingerprints_equal_those_of_joined_texts(spark):
    """Plain, noisy, nested, empty and missing html; the joined sides hold hashes only."""
    htmls = ["<p>One two</p>", "<nav>x</nav><p>a b a</p>", "<div class='sidebar'><div>n</div></div><main>kept</main>", "", None, "  ...  "]
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    new = P.page_fingerprints(pages.withColumn("filtered_text", F.lit("a clashing column")))
    old = P.fingerprints(pages.join(T.filtered_text(pages), "page_id"))
    assert sorted(new.collect(), key=lambda r: r["page_id"]) == sorted(old.select(*new.columns).collect(), key=lambda r: r["page_id"]) and new.count() == len(htmls)
    plan = new._jdf.queryExecution().optimizedPlan()
    joins = [n.output().mkString(",") for n in _nodes(plan) if n.nodeName() == "Join"]
    assert joins and "html" not in joins[0]


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_fast_hash_gives_a_signature_too(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, "")], "id int, text string")
    got = {r["id"]: r["simhash"] for r in P.simhash(df, ["id"], "text", X.fast_hash64).collect()}
    assert got[1] == got[2] != 0 and got[3] == 0


@pytest.mark.parametrize("value", [0, 1, 2**63 - 1, -(2**63), -1])
def test_unsigned_round_trip(evaluate, value):
    unsigned = X.to_unsigned(F.lit(value).cast("bigint"))
    assert int(evaluate(unsigned)) == value % (1 << 64)
    assert evaluate(X.from_unsigned(unsigned)) == value


PRINTS = "id int, binary_hash string, filtered_hash string, simhash bigint"
CASES = [
    # new, old, plain verdict, verdict of the semantic variant
    (("a", "f", 0), None, (True, "BINARY", None), (True, "BINARY", None)),
    (("a", "f", 0), (None, None, None), (True, "BINARY", None), (True, "BINARY", None)),
    (("a", "f", 0), ("a", "g", 0), (False, "NONE", None), (False, "NONE", None)),
    (("a", "f", 0), ("b", "g", 0), (True, "FILTERED", None), (False, "NONE", 0)),
    (("a", "f", 0), ("b", "f", None), (True, "BINARY", None), (True, "BINARY", None)),
    (("a", "f", 0), ("b", "f", 63), (True, "SEMANTIC", 6), (True, "SEMANTIC", 6)),
    (("a", "f", 0), ("b", "f", 31), (False, "NONE", 5), (False, "NONE", 5)),
    (("a", "f", 0), ("b", "g", 127), (True, "FILTERED", None), (True, "SEMANTIC", 7)),
]


@pytest.mark.parametrize("semantic", [False, True])
def test_decision_table(spark, semantic):
    new = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], PRINTS)
    old = spark.createDataFrame([(i, *c[1]) for i, c in enumerate(CASES) if c[1]], PRINTS)
    rows = P.detect_changes(new, old, "id", semantic=semantic).collect()
    got = {r["id"]: (r["change_detected"], r["change_type"], r["hamming_distance"]) for r in rows}
    assert got == {i: c[3 if semantic else 2] for i, c in enumerate(CASES)}


def test_changed_pages(spark):
    base = "<body><nav>a</nav><p>Text one.</p></body>"
    rows = [(0, base, base), (1, base, base.replace("<nav>a", "<nav>b")), (2, base, base.replace("one", "two")), (3, None, base)]
    got = {r["page_id"]: r["change_type"] for r in S.changed_pages(spark.createDataFrame(rows, "page_id int, old_html string, new_html string")).collect()}
    assert got == {0: "NONE", 1: "NONE", 2: "FILTERED", 3: "BINARY"}


def test_tune_threshold(spark):
    shape = "expected_change boolean, new_binary_hash string, new_filtered_hash string, new_simhash bigint, old_binary_hash string, old_filtered_hash string, old_simhash bigint"
    def pair(bits, label):
        return (label, "a", "f", (1 << bits) - 1, "b", "f", 0)
    rows = [pair(3, False), pair(7, False), pair(9, True), pair(20, True)]
    assert P.tune_threshold(spark.createDataFrame(rows, shape)).first().asDict() == {"threshold": 7, "accuracy": 1.0}
    assert P.tune_threshold(spark.createDataFrame([], shape), current=4).first()["threshold"] == 4
    never = [(True, "a", "f", 0, "a", "f", 0)]
    assert P.tune_threshold(spark.createDataFrame(never, shape), current=9).first().asDict() == {"threshold": 9, "accuracy": 0.0}


def near_signatures(seed, n):
    """Clusters of signatures a few bits apart, with exact copies, and noise."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        value = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            value ^= 1 << rng.randrange(64)
        out.append(value - (1 << 64) if value >= 1 << 63 else value)
    out[: n // 3] = [out[0]] * (n // 3)  # one signature holds a third of the rows
    rng.shuffle(out)
    return out


def bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def greedy(signatures, threshold):
    group = {}
    for i, a in enumerate(signatures):
        if i in group:
            continue
        found = [j for j in range(i + 1, len(signatures)) if j not in group and bits(a, signatures[j]) <= threshold]
        if found:
            group.update({j: i for j in [i, *found]})
    return group


@pytest.mark.parametrize("threshold, blocks", [(0, 1), (3, 4), (5, 6), (5, 8), (3, 7)])
def test_pairs_match_brute_force(spark, threshold, blocks):
    sigs = near_signatures(threshold * 10 + blocks, 160)
    nodes = N.signature_nodes(spark.createDataFrame(list(enumerate(sigs)), "doc_id int, simhash bigint"))
    lead = {}
    for i, s in enumerate(sigs):
        lead.setdefault(s, i)
    want = sorted((i, j, bits(a, b)) for a, i in lead.items() for b, j in lead.items() if i < j and bits(a, b) <= threshold)
    got = sorted(tuple(r) for r in N.near_pairs(nodes, threshold, blocks).collect())
    assert got == want


@pytest.mark.parametrize("seed, threshold, dense", [(1, 5, 512), (2, 5, 3), (3, 3, 2), (4, 8, 1)])
def test_groups_match_the_sequential_pass(spark, seed, threshold, dense):
    sigs = near_signatures(seed, 150)
    df = spark.createDataFrame(list(enumerate(sigs)), "doc_id int, simhash bigint")
    rows = N.greedy_groups(df, threshold=threshold, dense_bucket=dense).collect()
    assert {r["doc_id"]: r["group_id"] for r in rows} == greedy(sigs, threshold)
    assert all(r["distance"] == bits(sigs[r["doc_id"]], sigs[r["group_id"]]) for r in rows)


def test_full_buckets_without_near_nodes_need_few_steps(spark, monkeypatch):
    """Signatures that share 40 bits and are seldom near; once every round settled only the first ones of such a bucket."""
    rng = random.Random(7)
    sigs = [(0x5A5A5A5A5A << 24) | rng.getrandbits(24) for _ in range(300)]
    steps = []
    monkeypatch.setattr(N, "cut", lambda df, cut=N.cut: steps.append(1) or cut(df))
    rows = N.greedy_groups(spark.createDataFrame(list(enumerate(sigs)), "doc_id int, simhash bigint"), threshold=5, dense_bucket=8).collect()
    assert {r["doc_id"]: r["group_id"] for r in rows} == greedy(sigs, 5)
    assert len(steps) < 30


def test_groups_over_short_and_halved_runs(spark, monkeypatch):
    """Runs of 16 nodes, of which the first two are halved as every node counts as too many pairs."""
    for name, value in (("RUN_NODES", 16), ("FIRST_RUN", 4), ("MOST_PAIRS", 0), ("SHARE", 1)):
        monkeypatch.setattr(N, name, value)
    sigs = near_signatures(11, 150)
    rows = N.greedy_groups(spark.createDataFrame(list(enumerate(sigs)), "doc_id int, simhash bigint"), threshold=8, dense_bucket=4).collect()
    assert {r["doc_id"]: r["group_id"] for r in rows} == greedy(sigs, 8)


def test_more_blocks_for_more_nodes():
    assert N.choose_blocks(1000, 5) < N.choose_blocks(10**7, 5) <= N.choose_blocks(10**10, 5)
