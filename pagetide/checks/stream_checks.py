"""Streaming forms (J).  Each query runs its stream to the end of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import plain, query
from pagetide.plans import derived as V
from pagetide.plans.run import run_scan
from pagetide.sources import schemas
from pagetide.sources.scratch import scratch_path
from pagetide.sources.tables import TableStore
from pagetide.streaming import incremental as I
from pagetide.streaming import summaries as S


def event_stream(spark, d) -> DataFrame:
    V.prepare(spark)
    shape = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(d)


def versions(spark, d, column: str, at: str) -> DataFrame:
    """Page snapshots of one delivery."""
    return V.snapshot_pairs(spark, d).filter(F.col(column).isNotNull()).select(
        F.col("page_id").cast("string").alias("target_id"), "url", F.col(column).alias("html"),
        F.lit("requests").alias("fetch_method"), F.lit(at).cast("timestamp").alias("scan_ts"),
    )


@query("j1_incremental_scan", f"""WITH {Q.SNAPSHOT_PAIRS},
h AS (SELECT page_id, old_html, new_html, {Q.clean('old_html')} AS o, {Q.clean('new_html')} AS n FROM snapshot_pairs),
c AS (SELECT *, old_html IS NOT NULL AND old_html <> new_html AND o <> n AS changed FROM h)
SELECT CAST(page_id AS VARCHAR) AS target_id, sha256(new_html) AS binary_hash, sha256(n) AS filtered_hash,
  CASE WHEN changed THEN 'BIWEEKLY' ELSE 'MONTHLY' END AS watch_mode,
  CASE WHEN changed THEN '2024-02-15 00:00:00.000000' ELSE '2024-03-02 00:00:00.000000' END AS next_run_at,
  CAST(CASE WHEN changed OR old_html IS NULL THEN 0 ELSE 1 END AS BIGINT) AS no_change_streak,
  CAST(CASE WHEN old_html IS NULL THEN 1 ELSE 2 END AS BIGINT) AS total_scans,
  CAST(CASE WHEN old_html IS NULL THEN 1 ELSE 2 END AS BIGINT) AS audit_rows
FROM c""")
def incremental(spark, d):
    """Two deliveries of page snapshots, the stream stopped in between."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    store = TableStore(spark, scratch_path(spark, "store"))
    V.prepare(spark)
    store.create()
    keywords = F.array(F.lit("deadline"), F.lit("call for papers"))
    for column, at in (("old_html", "2024-01-31 06:00:00"), ("new_html", "2024-02-01 06:00:00")):
        versions(spark, d, column, at).write.mode("append").parquet(landing)
        I.start_scanning(I.landed_snapshots(spark, landing), store, keywords, checkpoint).awaitTermination()
    audited = store.audit().groupBy("target_id").agg(F.count(F.lit(1)).alias("audit_rows"))
    columns = ("target_id", "binary_hash", "filtered_hash", "watch_mode", "next_run_at", "no_change_streak", "total_scans")
    return plain(store.state().select(*columns).join(audited, "target_id"))


RUNS = (("first", "old_html", "2024-01-31 06:00:00"), ("second", "new_html", "2024-02-01 06:00:00"), ("third", "new_html", "2024-03-02 06:00:00"))


@query("j1_whole_runs", f"""WITH {Q.SNAPSHOT_PAIRS},
h AS (SELECT page_id, old_html, new_html, {Q.clean('old_html')} AS o, {Q.clean('new_html')} AS n FROM snapshot_pairs),
c AS (SELECT page_id, old_html IS NOT NULL AND old_html <> new_html AND o <> n AS changed, old_html IS NULL AS fresh FROM h),
r AS (
  SELECT page_id, '2024-01-31 06:00:00.000000' AS scan_ts, false AS changed FROM c WHERE NOT fresh UNION ALL
  SELECT page_id, '2024-02-01 06:00:00.000000', false FROM c WHERE fresh UNION ALL
  SELECT page_id, '2024-03-02 06:00:00.000000', changed FROM c)
SELECT CAST(page_id AS VARCHAR) AS target_id, scan_ts, changed AS change_detected, CASE WHEN changed THEN 'FILTERED' ELSE 'NONE' END AS change_type,
  'MONTHLY' AS previous_watch_mode, CASE WHEN changed THEN 'BIWEEKLY' ELSE 'MONTHLY' END AS new_watch_mode,
  CASE WHEN changed THEN 'CONTENT_UPDATED_NO_DATES' ELSE 'NO_CHANGE' END AS transition_reason,
  CASE WHEN NOT changed THEN NULL WHEN page_id % 3 = 0 THEN 'Reply ' || page_id ELSE 'Content updated' END AS summary,
  page_id / 100 AS scan_duration_seconds, changed AND page_id % 3 = 0 AS llm_api_called, scan_ts NOT LIKE '2024-02%' AS email_sent
FROM r""")
def whole_runs(spark, d):
    """Three runs over all pages as targets: the second finds only those due that the first had no page for, and its report does not go out."""
    store = TableStore(spark, scratch_path(spark, "store"))
    V.prepare(spark)
    store.create()
    number = F.col("target_id").cast("bigint")
    targets = V.snapshot_pairs(spark, d).select(F.col("page_id").cast("string").alias("target_id"), F.col("url").alias("primary_url"))
    for run, column, at in RUNS:
        pages = versions(spark, d, column, at).withColumn("fetch_duration_ms", number * 10)
        replies = pages.filter(number % 3 == 0).select("target_id", "scan_ts", F.concat(F.lit("Reply "), "target_id").alias("summary"))
        run_scan(store, targets, pages, F.array(F.lit("no such words")), run, F.lit(at).cast("timestamp"), replies=replies, deliver=lambda report: report.run != "second")
    columns = [c for c in store.audit().columns if c not in ("audit_id", "day", "hamming_distance", "deadlines_found", "fetch_method")]
    return plain(store.audit().select(*columns))


@query("j2_streaming_watch_modes", Q.with_watch(f"""
SELECT target_id, arg_max(new_watch_mode, (scan_ts, event_id)) AS watch_mode, count(*) AS scans, count(*) FILTER (NOT ok) AS failures,
  {Q.ts('max(scan_ts)')} AS last_scan_at FROM watch GROUP BY 1"""))
def modes(spark, d):
    out = scratch_path(spark, "modes")
    I.update_into(I.watch_modes(V.log_from_events(event_stream(spark, d))), out, scratch_path(spark, "stream")).awaitTermination()
    return plain(I.latest_updates(spark, out, ["target_id"]))


@query("j2_streaming_watch_states", Q.with_watch(f"""
SELECT target_id, previous_watch_mode, new_watch_mode AS watch_mode, transition_reason, no_change_streak, error_streak,
  count(*) OVER (PARTITION BY target_id) AS scans, {Q.ts('scan_ts')} AS last_scan_at
FROM watch QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY scan_ts DESC, event_id DESC) = 1"""))
def states(spark, d):
    """The log in three batches, each with scans of the whole time."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "states")
    events = V.table(spark, d, "events")
    for k in range(3):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.mode("append").parquet(f"{landing}/part={k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(landing)
    S.summarise_into(V.log_from_events(stream), out, scratch_path(spark, "stream")).awaitTermination()
    return plain(S.watch_states(S.latest_summaries(spark, out)))


@query("j3_streaming_daily_activity", Q.with_log(f"""
SELECT {Q.ts("date_trunc('day', scan_ts)")} AS day, count(*) AS total_scans,
  count(*) FILTER (change_detected AND status = 'succeeded') AS changes_detected, count(*) FILTER (email_sent) AS emails_sent,
  count(*) FILTER (llm_api_called) AS llm_calls FROM scan_log
GROUP BY date_trunc('day', scan_ts)
HAVING date_trunc('day', scan_ts) + INTERVAL 1 DAY <= (SELECT max(scan_ts) - INTERVAL 1 DAY FROM scan_log)"""))
def activity(spark, d):
    """Days whose end lies more than the lateness back; the last ones are still open."""
    out = scratch_path(spark, "activity")
    I.append_to(I.daily_activity(V.log_from_events(event_stream(spark, d))), out, scratch_path(spark, "stream")).awaitTermination()
    return plain(spark.read.parquet(out))


@query("j4_redelivered_rows_dropped", Q.with_log(f"SELECT event_id, target_id, {Q.ts('scan_ts')} AS scan_ts FROM scan_log"))
def redelivered(spark, d):
    """Every event delivered twice."""
    out = scratch_path(spark, "distinct")
    twice = event_stream(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    log = V.log_from_events(twice).select("event_id", "target_id", "scan_ts")
    I.append_to(I.drop_redelivered(log, ["event_id"], lateness="40 days"), out, scratch_path(spark, "stream")).awaitTermination()
    return plain(spark.read.parquet(out))
