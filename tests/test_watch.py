"""Watch state against a scan-by-scan fold."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetide.functions import modes as M
from pagetide.operators import watch as W
from pagetide.operators.running import Running, running, sliced_running, slices, time_chunk

LOG = "target_id int, event_id bigint, scan_ts timestamp, status string, change_detected boolean, deadlines_count int"


def random_log(seed, n=1500):
    """Target 0 has a third of all scans; many of its scans share a chunk."""
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        target = 0 if rng.random() < 0.34 else rng.randrange(1, 40)
        ts = start + timedelta(seconds=rng.randrange(5) if rng.random() < 0.3 else rng.randrange(86400 * 3))
        failed = rng.random() < 0.4
        changed = rng.random() < 0.1
        rows.append((target, i, ts, "failed" if failed else "succeeded", changed, rng.randrange(1, 3) if changed and rng.random() < 0.2 else 0))
    return rows


def fold(rows):
    out, state = {}, {}
    for target, event, _, status, changed, found in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        s = state.setdefault(target, {"mode": "MONTHLY", "quiet": 0, "errors": 0, "seen": False, "scans": 0})
        before, reason, baseline = s["mode"], None, False
        if status == "failed":
            s["errors"] += 1
        else:
            baseline = not s["seen"]
            s["seen"], s["errors"] = True, 0
            s["scans"] += 1
            if before == "URGENT":
                reason = "ALREADY_URGENT"
            elif not changed:
                reason = "NO_CHANGE"
            elif found:
                s["mode"], reason = "URGENT", "DEADLINES_PUBLISHED"
            elif before == "MONTHLY":
                s["mode"], reason = "BIWEEKLY", "CONTENT_UPDATED_NO_DATES"
            else:
                reason = "CONTINUE_MONITORING"
            s["quiet"] = 0 if changed or baseline else s["quiet"] + 1
        out[event] = (before, s["mode"], reason, baseline, s["quiet"], s["errors"], s["scans"])
    return out


@pytest.mark.parametrize("seed, chunk", [(1, 3600), (2, 1), (3, 86400 * 30)])
def test_history_is_the_fold(spark, seed, chunk):
    rows = random_log(seed)
    out = W.watch_history(spark.createDataFrame(rows, LOG), chunk).collect()
    got = {
        r["event_id"]: (r["previous_watch_mode"], r["new_watch_mode"], r["transition_reason"], r["is_baseline"], r["no_change_streak"],
                        r["error_streak"], r["scans_so_far"]) for r in out
    }
    assert got == fold(rows)


@pytest.mark.parametrize("mode, changed, found, new, reason", [
    ("MONTHLY", False, 0, "MONTHLY", "NO_CHANGE"), ("MONTHLY", True, 0, "BIWEEKLY", "CONTENT_UPDATED_NO_DATES"),
    ("MONTHLY", True, 2, "URGENT", "DEADLINES_PUBLISHED"), ("MONTHLY", False, 2, "MONTHLY", "NO_CHANGE"),
    ("BIWEEKLY", False, 0, "BIWEEKLY", "NO_CHANGE"), ("BIWEEKLY", True, 0, "BIWEEKLY", "CONTINUE_MONITORING"),
    ("BIWEEKLY", True, 1, "URGENT", "DEADLINES_PUBLISHED"), ("URGENT", False, 0, "URGENT", "ALREADY_URGENT"),
    ("URGENT", True, 3, "URGENT", "ALREADY_URGENT"),
])
def test_transition_table(evaluate, mode, changed, found, new, reason):
    args = F.lit(mode), F.lit(changed), F.lit(found)
    assert evaluate(M.next_mode(*args)) == new
    assert evaluate(M.transition_reason(*args)) == reason


def test_next_run_and_time_left(evaluate):
    base = F.lit("2026-02-14 10:20:30").cast("timestamp")
    assert evaluate(M.next_run(F.lit("BIWEEKLY"), base, 9)) == datetime(2026, 2, 28, 9)
    assert evaluate(M.next_run(F.lit("MONTHLY"), base)) == datetime(2026, 3, 16)
    assert evaluate(M.next_run(F.lit("URGENT"), base, 6, 30)) == datetime(2026, 2, 15, 6, 30)
    assert evaluate(M.overdue(base, base)) is True
    assert evaluate(M.seconds_until(base, F.lit("2026-02-14 10:20:40").cast("timestamp"))) == -10.0


def test_alerts(evaluate):
    assert [n for n in range(16) if evaluate(M.alert_due(F.lit(n)))] == [1, 7, 14]


def test_running_equals_plain_windows(spark):
    rows = [(t, e, ts, v if e % 4 else None) for t, e, ts, _, _, v in random_log(7)]
    df = spark.createDataFrame(rows, "k int, e bigint, ts timestamp, v int")
    plain = Window.partitionBy("k").orderBy("ts", "e")
    upto, before = plain.rowsBetween(Window.unboundedPreceding, 0), plain.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("e", F.coalesce(F.sum("v").over(upto), F.lit(0)), F.coalesce(F.sum("v").over(before), F.lit(0)),
                     F.max("v").over(before), F.last("v", True).over(upto)).collect()
    measures = [
        Running("s", "sum", F.col("v")), Running("b", "sum", F.col("v"), False), Running("m", "max", F.col("v"), False), Running("l", "last", F.col("v")),
    ]
    chunked = running(df, ["k"], ["ts", "e"], time_chunk(F.col("ts"), 600), measures)
    sliced = sliced_running(df, ["k"], ["ts", "e"], measures, number=7)
    assert sliced.columns == chunked.columns == [*df.columns, "s", "b", "m", "l"]
    for out in (chunked, sliced):
        got = out.select("e", "s", "b", "m", "l").collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, want), key=lambda r: r[0])


def test_slices_are_even_and_in_order(spark):
    """One key at one time over all of the table: many slices, none large, numbers rising with the order."""
    df = spark.range(200_000, numPartitions=8).select(F.lit("k").alias("k"), F.lit(0).alias("t"), "id")
    found = slices(df, ["k"], ["t", "id"], 16).groupBy("_slice").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_slice").collect()
    assert len(found) >= 14 and max(r["n"] for r in found) < 2 * 200_000 / 16
    assert sum(r["n"] for r in found) == 200_000 and all(x["b"] < y["a"] for x, y in zip(found, found[1:]))


def test_history_by_slices_equals_history_by_the_clock(spark):
    df = spark.createDataFrame([r[:2] + (datetime(2026, 1, 1),) + r[3:] for r in random_log(5)], LOG)
    by_clock, by_slice = (W.watch_history(df, c).collect() for c in (3600, None))
    assert len(by_clock) == 1500 and sorted(by_clock, key=lambda r: r["event_id"]) == sorted(by_slice, key=lambda r: r["event_id"])
    known = [{(r["event_id"], r["known_deadlines_count"]) for r in W.carry_forward(df, ["deadlines_count"], c).collect()} for c in (3600, None)]
    assert known[0] == known[1]


def test_no_task_gets_a_whole_target(spark):
    """The windows over rows are keyed by target and time chunk."""
    df = spark.createDataFrame(random_log(1, 50), LOG)
    plan = W.watch_history(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "event_id" in line]
    assert windows and all("_chunk" in line for line in windows)
