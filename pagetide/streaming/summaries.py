"""Watch states from batches in any order: summaries of time chunks that combine.

What a chunk of a target's scans does to its state is a small summary: the
highest outcome, how many scans were quiet or failed at its end, and its last
scan.  Summaries of neighbouring chunks combine associatively, so a
target's state is the fold of its chunks, however many scans they hold.

A batch may bring rows of any time.  Its rows are kept by chunk; the chunks it
touches are summarised anew, with two aggregates and no window, and
the newest summary of each chunk counts.  A batch done again writes the
same folders again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetide.functions import modes as M
from pagetide.operators.running import time_chunk

KEYS = ["target_id", "chunk"]
KEPT = ("target_id", "event_id", "scan_ts", "status", "change_detected", "deadlines_count")
DAY = 86_400


def chunk_summaries(rows: DataFrame) -> DataFrame:
    """One row per target and chunk: `s`, the summary of its scans.

    `rows` has `chunk` and the columns of a scan log.  Both aggregates combine in each task
    before the shuffle; the ends that the second one looks back from are one row a chunk.
    """
    ok = F.col("status") == "succeeded"
    order = F.struct("scan_ts", "event_id")
    scans = rows.select(
        *KEYS, order.alias("order"), ok.alias("ok"), (ok & F.col("change_detected")).alias("changed"), "deadlines_count",
        F.when(ok, M.outcome_rank(F.col("change_detected"), F.col("deadlines_count"))).otherwise(0).alias("rank"),
    )
    ends = scans.groupBy(*KEYS).agg(
        F.max(F.when(F.col("changed"), F.col("order"))).alias("last_change"), F.max(F.when(F.col("ok"), F.col("order"))).alias("last_ok"),
        F.max_by(F.struct("order", "ok", "changed", "deadlines_count"), "order").alias("last"),
    )

    def after(end: str) -> Column:
        return F.coalesce(F.col("order") > F.col(end), F.lit(True))

    quiet = F.col("ok") & ~F.col("changed")
    counted = scans.join(ends, KEYS).groupBy(*KEYS).agg(
        F.first("last").alias("last"), F.count(F.lit(1)).alias("scans"), F.max("rank").alias("rank"),
        F.coalesce(F.max(F.when(F.col("order") < F.col("last.order"), F.col("rank"))), F.lit(0)).alias("rank_before"),
        F.count_if("ok").alias("ok"), F.count_if("changed").alias("changes"),
        F.count_if(quiet & after("last_change")).alias("quiet"), F.count_if(~F.col("ok") & after("last_ok")).alias("failed"),
    )
    return counted.select(*KEYS, F.struct("scans", "rank", "rank_before", "ok", "changes", "quiet", "failed", "last").alias("s"))


def combined(a: Column, b: Column) -> Column:
    """The summary of two neighbouring stretches of time, the earlier one first."""
    return F.struct(
        (a["scans"] + b["scans"]).alias("scans"), F.greatest(a["rank"], b["rank"]).alias("rank"),
        F.greatest(a["rank"], b["rank_before"]).alias("rank_before"),
        (a["ok"] + b["ok"]).alias("ok"), (a["changes"] + b["changes"]).alias("changes"),
        (F.when(b["changes"] > 0, 0).otherwise(a["quiet"]) + b["quiet"]).alias("quiet"),
        (F.when(b["ok"] > 0, 0).otherwise(a["failed"]) + b["failed"]).alias("failed"),
        b["last"].alias("last"),
    )


def watch_states(summaries: DataFrame) -> DataFrame:
    """Per target: previous and current mode, reason of the last scan, both streaks, counts; from one summary per chunk."""
    listed = summaries.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("chunks"))
    whole = F.aggregate(F.slice("chunks", F.lit(2), F.size("chunks")), F.col("chunks")[0]["s"], lambda a, c: combined(a, c["s"]))
    folded = listed.select("target_id", whole.alias("s"))
    last, before = F.col("s.last"), M.mode_name(F.col("s.rank_before"))
    # without any change, the first success is the baseline, which is not counted
    baseline = F.when((F.col("s.changes") == 0) & (F.col("s.ok") > 0), 1).otherwise(0)
    return folded.select(
        "target_id", before.alias("previous_watch_mode"), M.mode_name(F.col("s.rank")).alias("watch_mode"),
        F.when(last["ok"], M.transition_reason(before, last["changed"], last["deadlines_count"])).alias("transition_reason"),
        (F.col("s.quiet") - baseline).alias("no_change_streak"), F.col("s.failed").alias("error_streak"),
        F.col("s.scans").alias("scans"), last["order"]["scan_ts"].alias("last_scan_at"),
    )


def summarise_into(log: DataFrame, path: str, checkpoint: str, chunk_seconds: int = DAY) -> StreamingQuery:
    """Keep the summaries of a scan log under `path`, up to the present; repeated event ids of a target count once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*KEPT).withColumn("chunk", time_chunk(F.col("scan_ts"), chunk_seconds))
        fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        landed = spark.read.parquet(f"{path}/rows").filter(F.col("batch") <= batch_id)
        mine = landed.filter(F.col("batch") == batch_id)
        first, last = mine.select(F.min("chunk"), F.max("chunk")).first()
        touched = landed.filter(F.col("chunk").between(first, last)).join(mine.select(*KEYS).distinct(), KEYS, "left_semi") if first is not None else mine
        once = touched.dropDuplicates(["target_id", "chunk", "event_id"])
        chunk_summaries(once).write.mode("overwrite").parquet(f"{path}/summaries/batch={batch_id}")

    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary of each target and chunk."""
    return spark.read.parquet(f"{path}/summaries").groupBy(*KEYS).agg(F.max_by("s", "batch").alias("s"))
