"""Summaries of scan logs: any cut, any order of batches."""

from __future__ import annotations

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagetide.operators.running import time_chunk
from pagetide.operators.watch import watch_history
from pagetide.streaming import summaries as S

SHAPE = "target_id string, event_id long, scan_ts timestamp, status string, change_detected boolean, deadlines_count int"


def random_log(seed, n=400):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        target = rng.choice("abcdefgh")
        kind = rng.choices(["quiet", "failed", "changed", "dated"], {"a": (1, 0, 0, 0), "b": (0, 1, 0, 0), "c": (8, 8, 1, 0)}.get(target, (8, 4, 2, 1)))[0]
        # several scans of one time, told apart by their event
        rows.append((target, i, start + timedelta(hours=rng.randrange(200)), "failed" if kind == "failed" else "succeeded", kind in ("changed", "dated"), 2 if kind == "dated" else 0))
    return rows


def expected(log):
    last = watch_history(log).groupBy("target_id").agg(F.max_by(F.struct(
        "previous_watch_mode", F.col("new_watch_mode").alias("watch_mode"), "transition_reason", "no_change_streak", "error_streak"), F.struct("scan_ts", "event_id")).alias("r"), F.count(F.lit(1)).alias("scans"))
    return sorted(tuple(r) for r in last.select("target_id", "r.*", "scans").collect())


def got(states):
    return sorted(tuple(r) for r in states.drop("last_scan_at").collect())


@pytest.mark.parametrize("chunk", [3600, 86_400, 40 * 86_400])
def test_states_for_any_length_of_chunk(spark, chunk):
    log = spark.createDataFrame(random_log(1), SHAPE)
    summaries = S.chunk_summaries(log.withColumn("chunk", time_chunk(F.col("scan_ts"), chunk)))
    assert got(S.watch_states(summaries)) == expected(log)
    assert got(S.watch_states(S.chunk_summaries(log.limit(0).withColumn("chunk", F.lit(0))))) == []


def test_combining_is_associative(spark):
    """Folding from the right gives what folding from the left gives."""
    log = spark.createDataFrame(random_log(2), SHAPE)
    summaries = S.chunk_summaries(log.withColumn("chunk", time_chunk(F.col("scan_ts"), 7200)))
    listed = summaries.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("c"))
    backwards = F.aggregate(F.slice(F.reverse("c"), 2, 10_000), F.element_at("c", -1)["s"], lambda a, x: S.combined(x["s"], a))
    one = listed.select("target_id", F.lit(0).alias("chunk"), backwards.alias("s"))
    assert got(S.watch_states(one)) == got(S.watch_states(summaries)) == expected(log)


def test_batches_in_any_order_and_twice(spark):
    rows = random_log(3)
    root = tempfile.mkdtemp(prefix="pagetide-test-")
    random.Random(4).shuffle(rows)
    shown = []
    for k in range(0, len(rows), 100):
        # each batch brings some rows of the one before again
        spark.createDataFrame(rows[max(k - 20, 0):k + 100], SHAPE).coalesce(1).write.parquet(f"{root}/in/{k}")
        stream = spark.readStream.schema(SHAPE).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        S.summarise_into(stream, f"{root}/out", f"{root}/cp").awaitTermination()
        shown.append(got(S.watch_states(S.latest_summaries(spark, f"{root}/out"))) == expected(spark.createDataFrame(rows[:k + 100], SHAPE)))
    assert shown == [True] * 4


def test_scans_are_added_up_before_the_shuffle(spark):
    log = spark.createDataFrame(random_log(5), SHAPE).withColumn("chunk", F.lit(1))
    plan = S.chunk_summaries(log)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan and "partial_count" in plan
