from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetide.operators import report as R
from pagetide.operators import requests as A


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def deadlines(n):
    one = F.struct(F.lit("2026-03-15").cast("date").alias("date"), F.lit("paper").alias("type"), F.lit("s" * 150).alias("source_text"))
    return F.array(*[one] * n) if n else F.slice(F.array(one), 1, 0)


def test_prompt_limits_and_stand_ins(evaluate):
    full = evaluate(A.summary_prompt(F.lit("N"), strings(*[f"snippet {i}" for i in range(30)]), strings(*[f"k{i}" for i in range(30)]), deadlines(9)))
    assert full.count("- snippet") == 20 and "k9" in full and "k10" not in full
    assert full.count("- 2026-03-15 (paper): " + "s" * 100 + "\n") == 5 and "s" * 101 not in full
    bare = evaluate(A.summary_prompt(F.lit("N"), strings(), strings(), deadlines(0)))
    assert all(x in bare for x in (A.NO_SNIPPETS, A.NO_KEYWORDS, A.NO_DEADLINES))
    assert evaluate(A.no_dates_prompt(F.lit("N"), strings(*["x"] * 20), "{name}|{snippets}")) == "N|" + "\n".join(["- x"] * 15)
    assert evaluate(A.classify_prompt(F.lit("y" * 4001), "{content}")) == "y" * 4000 + A.CUT_MARK
    assert evaluate(A.classify_prompt(F.lit("y" * 4000), "{content}")) == "y" * 4000


def test_cache_key(evaluate):
    want = "t:" + hashlib.sha256(("t" + "|".join(f"s{i}" for i in range(10))).encode()).hexdigest()[:16]
    assert evaluate(A.cache_key(F.lit("t"), strings(*[f"s{i}" for i in range(12)]))) == want


def test_cache_time_to_live(spark):
    at = lambda d, h, s=0: datetime(2026, 1, d, h, 0, s)
    asks = spark.createDataFrame([(1, "k", at(1, 9)), (2, "k", at(1, 10)), (3, "k", at(2, 10)), (4, "k", at(2, 10, 1)), (5, "q", at(1, 10))],
                                 "request_id int, cache_key string, requested_at timestamp")
    replies = spark.createDataFrame([("k", at(1, 10), "r1")], "cache_key string, responded_at timestamp, reply string")
    got = {r["request_id"]: (r["cache_status"], r["reply"]) for r in A.cache_lookup(asks, replies).collect()}
    assert got == {1: ("pending", None), 2: ("hit", "r1"), 3: ("hit", "r1"), 4: ("pending", None), 5: ("pending", None)}


def test_budget_lets_the_last_call_pass(spark):
    rows = [(i, datetime(2026, 1, 1, i), 1_000_000) for i in range(5)] + [(9, datetime(2026, 2, 1), 1)]
    calls = spark.createDataFrame(rows, "request_id int, requested_at timestamp, tokens long")
    got = {r["request_id"]: (r["spent_before"], r["allowed"]) for r in A.budget_gate(calls, 1.0).collect()}
    assert got == {0: (0.0, True), 1: (0.4, True), 2: (0.8, True), 3: (1.2, False), 4: (1.6, False), 9: (0.0, True)}
    stats = A.usage_stats(calls, 1.0).orderBy("month").first()
    assert (stats["call_count"], stats["monthly_cost"], stats["remaining_budget"]) == (5, 2.0, -1.0)


def test_budget_of_a_month_within_one_second(spark):
    """A backfill: all calls at one time are spread over tasks, and every sum is that of one window."""
    calls = spark.range(120_000, numPartitions=8).select(
        F.col("id").alias("request_id"), F.lit("2026-01-01 05:00:00").cast("timestamp").alias("requested_at"), (F.col("id") * 7919 % 100).alias("tokens"))
    gated = A.budget_gate(calls, 1.0, slices=12)
    whole = Window.partitionBy(F.lit(1)).orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    want = calls.select("request_id", F.coalesce(F.sum("tokens").over(whole), F.lit(0)).alias("before"))
    wrong = gated.join(want, "request_id").filter(
        (F.abs(F.col("spent_before") - F.col("before") * 0.4 / 1e6) > 1e-12) | (F.col("allowed") != (F.col("before") * 4 < 10_000_000)))
    assert gated.count() == 120_000 and wrong.count() == 0
    assert 0 < gated.filter("allowed").count() < 120_000


def test_cache_of_one_hot_key_equals_a_scan_over_it(spark):
    """Most requests and replies of one key, many of them at one time, some replies without text."""
    rng = random.Random(3)
    start = datetime(2026, 1, 1)

    def event():
        return "hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", start + timedelta(hours=rng.choice((0, 0, 1, 24, 25, rng.randrange(200))))

    asks = [(i, *event()) for i in range(400)]
    replies = [(*event(), rng.choice((None, "a", f"r{i}"))) for i in range(60)]
    want = {}
    for i, key, at in asks:
        before = [(t, "" if r is None else r, r) for k, t, r in replies if k == key and t <= at]
        last = max(before, key=lambda x: x[:2]) if before else None
        fresh = last is not None and at <= last[0] + timedelta(hours=24)
        want[i] = (last[2] if fresh else None, "hit" if fresh else "pending")
    out = A.cache_lookup(
        spark.createDataFrame(asks, "request_id int, cache_key string, requested_at timestamp"),
        spark.createDataFrame(replies, "cache_key string, responded_at timestamp, reply string"))
    assert {r["request_id"]: (r["reply"], r["cache_status"]) for r in out.collect()} == want


def test_fallback_summary(evaluate):
    assert evaluate(A.fallback_summary(deadlines(0), strings())) == "Content updated"
    assert evaluate(A.fallback_summary(deadlines(4), strings("a"))) == (
        "Found 4 deadline(s)" + ". - paper: 2026-03-15" * 3 + ". Content changes detected in 1 locations")


def test_reply_defaults(evaluate):
    got = evaluate(A.parse_reply(F.lit('{"summary": "S"}')))
    assert (got["valid"], got["summary"], got["relevance_score"], got["categories"], got["key_changes"]) == (True, "S", 0.5, [], [])
    full = evaluate(A.parse_reply(F.lit('{"summary": "S", "relevance_score": 0.9, "categories": ["CFP"], "potential_dates": [{"date_text": "May"}]}')))
    assert (full["relevance_score"], full["categories"], full["potential_dates"]) == (0.9, ["CFP"], [{"date_text": "May"}])
    bad = evaluate(A.parse_reply(F.lit("not json")))
    assert (bad["valid"], bad["summary"], bad["relevance_score"]) == (False, "not json", None)


def test_subject_lists_sections_in_order(spark):
    rows = [("r", "NO_CHANGE")] * 3 + [("r", "CHANGE_WITH_DATES"), ("q", "ERROR")]
    got = {r["run_id"]: r["subject"] for r in R.report_subjects(spark.createDataFrame(rows, "run_id string, section string")).collect()}
    assert got == {"r": "🚨 Scan report: 1 deadlines published, 3 no change", "q": "⚠️ Scan report: 1 error"}


def test_paragraphs(evaluate):
    assert evaluate(R.summary_paragraphs(F.lit("One.\n\n \n\n Two\nlines \n\n"))) == "<p>One.</p>\n<p>Two\nlines</p>"
