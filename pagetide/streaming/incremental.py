"""Scanning page snapshots as they land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetide.functions import modes as M
from pagetide.plans.scan import late_audit, on_time, scan_batch, scan_tables
from pagetide.sources import schemas
from pagetide.sources.scratch import cut
from pagetide.sources.tables import TableStore, upsert


def landed_snapshots(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the snapshot files put into `folder`."""
    reader = spark.readStream.schema(schemas.SNAPSHOTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def scan_into(store: TableStore, keywords: Column, stream: str = "stream"):
    """A foreachBatch function that scans a batch and writes the three tables.

    The batch is one run of the store (see `write_run`), named by the
    id of the query, which its checkpoint keeps, or `stream` outside of one.  A
    batch delivered again after it was finished is left alone; what an unfinished one
    has written is never seen.  Runs of other writers in between are kept, as each starts from the newest state.

    Redelivered snapshots, of the same target and time, count once.  One older
    than the target's last scan is written to audit as late and changes nothing.
    """

    def scan(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or stream
        name = f"{query}-{batch_id}"
        if store.has_batch(name):
            return
        base, state = store.version(), store.state()
        run = F.lit(f"batch-{name}")
        once = batch.dropDuplicates(["target_id", "scan_ts"])
        results = cut(scan_batch(on_time(once, state), state, keywords, run))
        added = scan_tables(results, state)
        store.write_run(name, base, upsert(state, added.state, ["target_id"]), added.audit.unionByName(late_audit(once, state, run)), added.history)

    return scan


def start_scanning(snapshots: DataFrame, store: TableStore, keywords: Column, checkpoint: str) -> StreamingQuery:
    """Scan everything that has landed, then stop; run again to go on."""
    return (
        snapshots.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(scan_into(store, keywords)).trigger(availableNow=True).start()
    )


def watch_modes(log: DataFrame) -> DataFrame:
    """Current mode and scan counts per target, as a streaming aggregate.

    A mode never falls, so the state of a target is a maximum and two counts.
    They are combined in each task before the shuffle: a target with very many
    scans costs no more than any other.
    """
    ok = F.col("status") == "succeeded"
    rank = F.when(ok, M.outcome_rank(F.col("change_detected"), F.col("deadlines_count"))).otherwise(0)
    return log.groupBy("target_id").agg(
        M.mode_name(F.max(rank)).alias("watch_mode"), F.count(F.lit(1)).alias("scans"), F.count_if(~ok).alias("failures"),
        F.max("scan_ts").alias("last_scan_at"),
    )


def daily_activity(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily counts, each sent once its day is over; later rows are dropped."""
    return log.withWatermark("scan_ts", lateness).groupBy(F.window("scan_ts", "1 day")).agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.count_if(F.col("change_detected") & (F.col("status") == "succeeded")).alias("changes_detected"),
        F.count_if("email_sent").alias("emails_sent"),
        F.count_if("llm_api_called").alias("llm_calls"),
    ).select(F.col("window.start").alias("day"), "total_scans", "changes_detected", "emails_sent", "llm_calls")


def drop_redelivered(log: DataFrame, keys: list[str], ts: str = "scan_ts", lateness: str = "1 day") -> DataFrame:
    """Each row once, however often it is delivered within the lateness."""
    return log.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet folder, exactly once, up to the present."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def update_into(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed rows of each batch under `path`, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of every key written by `update_into`."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
