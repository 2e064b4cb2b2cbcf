"""Watch state: modes, streaks, schedule, reconciliation, log rows (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import plain, query
from pagetide.functions import modes as M
from pagetide.operators import watch as W
from pagetide.plans import derived as V

RANK = "CASE watch_mode WHEN 'URGENT' THEN 2 WHEN 'BIWEEKLY' THEN 1 ELSE 0 END"


@query("f1_due_targets", Q.with_state(f"""
SELECT target_id, watch_mode, {Q.ts('next_run_at')} AS next_run_at FROM state
WHERE is_active AND next_run_at <= {Q.AS_OF}"""))
def due(spark, d):
    return plain(W.due_targets(V.state(spark, d), V.as_of()).select("target_id", "watch_mode", "next_run_at"))


@query("f1_all_active_targets", Q.with_state("SELECT target_id, watch_mode FROM state WHERE is_active"))
def forced(spark, d):
    return W.due_targets(V.state(spark, d), V.as_of(), force=True).select("target_id", "watch_mode")


@query("f2_priority_order", Q.with_state(f"""
SELECT target_id, watch_mode, {Q.ts('next_run_at')} AS next_run_at FROM state
WHERE is_active AND next_run_at <= {Q.AS_OF} ORDER BY {RANK} DESC, next_run_at, target_id"""))
def priority(spark, d):
    state = W.due_targets(V.state(spark, d), V.as_of())
    return plain(W.by_priority(state.select("target_id", "watch_mode", "next_run_at")))


@query("f3_mode_history", Q.with_watch("""
SELECT event_id, target_id, previous_watch_mode, new_watch_mode FROM watch"""))
def mode_history(spark, d):
    return V.watch_log(spark, d).select("event_id", "target_id", "previous_watch_mode", "new_watch_mode")


@query("f3_one_step_transition", Q.with_log("""
SELECT event_id, m AS old_mode,
  CASE WHEN m = 'URGENT' OR NOT change_detected THEN m WHEN deadlines_count > 0 THEN 'URGENT' ELSE 'BIWEEKLY' END AS new_mode
FROM (SELECT *, ['MONTHLY', 'BIWEEKLY', 'URGENT'][1 + target_id % 3] AS m FROM scan_log WHERE status = 'succeeded')"""))
def one_step(spark, d):
    log = V.scan_log(spark, d).filter("status = 'succeeded'").withColumn("old_mode", M.mode_name(F.col("target_id") % 3))
    return log.select(
        "event_id", "old_mode", M.next_mode(F.col("old_mode"), F.col("change_detected"), F.col("deadlines_count")).alias("new_mode")
    )


@query("f4_transition_reasons", Q.with_watch("""
SELECT event_id, target_id, transition_reason FROM watch WHERE ok"""))
def reasons(spark, d):
    return V.watch_log(spark, d).filter("status = 'succeeded'").select("event_id", "target_id", "transition_reason")


@query("f5_next_run", Q.with_watch(f"""
SELECT event_id, {Q.ts("date_trunc('day', scan_ts) + to_days(i)")} AS at_midnight,
  {Q.ts("date_trunc('day', scan_ts) + to_days(i) + INTERVAL 9 HOUR")} AS at_nine
FROM (SELECT *, CASE new_watch_mode WHEN 'MONTHLY' THEN 30 WHEN 'BIWEEKLY' THEN 14 ELSE 1 END AS i FROM watch WHERE ok)"""))
def next_run(spark, d):
    log = V.watch_log(spark, d).filter("status = 'succeeded'")
    return plain(log.select(
        "event_id", M.next_run(F.col("new_watch_mode"), F.col("scan_ts")).alias("at_midnight"),
        M.next_run(F.col("new_watch_mode"), F.col("scan_ts"), 9, 0).alias("at_nine"),
    ))


@query("f6_overdue_and_time_left", Q.with_state(f"""
SELECT target_id, CASE watch_mode WHEN 'MONTHLY' THEN 30 WHEN 'BIWEEKLY' THEN 14 ELSE 1 END AS interval_days,
  {Q.AS_OF} >= next_run_at AS overdue, CAST(epoch(next_run_at) - epoch({Q.AS_OF}) AS DOUBLE) AS seconds_left FROM state"""))
def time_left(spark, d):
    return V.state(spark, d).select(
        "target_id", M.interval_days(F.col("watch_mode")).alias("interval_days"),
        M.overdue(F.col("next_run_at"), V.as_of()).alias("overdue"),
        M.seconds_until(F.col("next_run_at"), V.as_of()).alias("seconds_left"),
    )


@query("f7_no_change_streak", Q.with_watch("SELECT event_id, target_id, is_baseline, no_change_streak FROM watch"))
def quiet_streak(spark, d):
    return V.watch_log(spark, d).select("event_id", "target_id", "is_baseline", "no_change_streak")


@query("f8_error_streak", Q.with_watch("SELECT event_id, target_id, error_streak FROM watch"))
def error_streak(spark, d):
    return V.watch_log(spark, d).select("event_id", "target_id", "error_streak")


@query("f9_failure_alerts", Q.with_watch("""
SELECT event_id, target_id, error_streak, error_message FROM watch
WHERE NOT ok AND (error_streak = 1 OR error_streak % 7 = 0)"""))
def alerts(spark, d):
    log = V.watch_log(spark, d).filter("status = 'failed'")
    return log.filter(M.alert_due(F.col("error_streak"))).select("event_id", "target_id", "error_streak", "error_message")


@query("f10_notification_class", Q.with_log("""
SELECT event_id, CASE WHEN NOT change_detected THEN 'NO_CHANGE' WHEN deadlines_count > 0 THEN 'CHANGE_WITH_DATES'
  ELSE 'CHANGE_NO_DATES' END AS email_type FROM scan_log WHERE status = 'succeeded'"""))
def notification(spark, d):
    log = V.scan_log(spark, d).filter("status = 'succeeded'")
    return log.select("event_id", M.notification_class(F.col("change_detected"), F.col("deadlines_count")).alias("email_type"))


@query("f11_carry_forward", Q.with_log("""
SELECT event_id, target_id, last_value(CASE WHEN deadlines_count > 0 THEN deadlines_count END IGNORE NULLS) OVER o AS known_deadlines,
  last_value(CASE WHEN llm_api_called THEN 'summary of scan ' || event_id END IGNORE NULLS) OVER o AS known_summary
FROM scan_log WINDOW o AS (PARTITION BY target_id ORDER BY scan_ts, event_id ROWS UNBOUNDED PRECEDING)
QUALIFY known_deadlines IS NOT NULL"""))
def carry(spark, d):
    log = V.scan_log(spark, d).withColumn("deadlines", F.expr("CASE WHEN deadlines_count > 0 THEN deadlines_count END"))
    log = log.withColumn("summary", F.expr("CASE WHEN llm_api_called THEN concat('summary of scan ', event_id) END"))
    out = W.carry_forward(log, ["deadlines", "summary"])
    return out.filter("known_deadlines IS NOT NULL").select("event_id", "target_id", "known_deadlines", "known_summary")


TARGETS_SQL = """
targets AS (
  SELECT CAST(s_suppkey * 20 AS VARCHAR) AS target_id,
    CASE WHEN s_acctbal < 0 THEN 'https://moved.example.org/' || s_suppkey ELSE 'HTTPS://Site' || (s_suppkey * 20) || '.Example.org' END AS primary_url
  FROM supplier)"""


def supplier_targets(spark, d):
    """A target list of suppliers: most are known, some moved, some are new."""
    return V.table(spark, d, "supplier").selectExpr(
        "cast(s_suppkey * 20 AS string) AS target_id",
        "CASE WHEN s_acctbal < 0 THEN concat('https://moved.example.org/', s_suppkey)"
        " ELSE concat('HTTPS://Site', s_suppkey * 20, '.Example.org') END AS primary_url",
    )


RECONCILE_SQL = f"""WITH {Q.SCAN_LOG},{Q.state()},{TARGETS_SQL},
j AS (
  SELECT s.target_id IS NOT NULL AS known, t.target_id IS NOT NULL AS listed, coalesce(s.target_id, t.target_id) AS id,
    s.* EXCLUDE (target_id), t.primary_url,
    s.target_id IS NOT NULL AND t.target_id IS NOT NULL AND t.primary_url LIKE '%moved%' AS moved
  FROM state s FULL OUTER JOIN targets t ON s.target_id = t.target_id)
"""


@query("f12_reconcile_targets", RECONCILE_SQL + f"""
SELECT id AS target_id, CASE WHEN known THEN watch_mode ELSE 'MONTHLY' END AS watch_mode,
  {Q.ts(f"CASE WHEN known THEN next_run_at ELSE {Q.AS_OF} END")} AS next_run_at, listed AS is_active,
  concat_ws(',', CASE WHEN NOT known THEN 'inserted' END, CASE WHEN moved THEN 'url_changed' END,
    CASE WHEN known AND is_active AND NOT listed THEN 'deactivated' END,
    CASE WHEN known AND NOT is_active AND listed THEN 'reactivated' END) AS action FROM j""")
def reconcile(spark, d):
    out = W.reconcile(V.state(spark, d), supplier_targets(spark, d), V.as_of())
    return plain(out.select("target_id", "watch_mode", "next_run_at", "is_active", "action"))


@query("f13_url_change_resets_baseline", RECONCILE_SQL + """
SELECT id AS target_id, CASE WHEN NOT known OR moved THEN primary_url ELSE url END AS url,
  CASE WHEN NOT moved THEN binary_hash END AS binary_hash, CASE WHEN NOT moved THEN filtered_hash END AS filtered_hash,
  CASE WHEN moved OR simhash IS NULL THEN 'none' ELSE CAST(simhash AS VARCHAR) END AS simhash FROM j""")
def url_reset(spark, d):
    out = W.reconcile(V.state(spark, d), supplier_targets(spark, d), V.as_of())
    return out.select("target_id", "url", "binary_hash", "filtered_hash", F.coalesce(F.col("simhash").cast("string"), F.lit("none")).alias("simhash"))


@query("f14_scan_summary", Q.with_state(f"""
SELECT count(*) AS total_active, count(*) FILTER (next_run_at <= t) AS overdue,
  count(*) FILTER (next_run_at > t AND next_run_at <= t + INTERVAL 1 DAY) AS today,
  count(*) FILTER (next_run_at > t + INTERVAL 1 DAY AND next_run_at <= t + INTERVAL 7 DAY) AS this_week,
  count(*) FILTER (watch_mode = 'MONTHLY') AS monthly, count(*) FILTER (watch_mode = 'BIWEEKLY') AS biweekly,
  count(*) FILTER (watch_mode = 'URGENT') AS urgent
FROM (SELECT *, {Q.AS_OF} AS t FROM state WHERE is_active)"""))
def summary(spark, d):
    return W.scan_summary(V.state(spark, d), V.as_of())


@query("f15_due_by_mode", Q.with_state(f"""
SELECT watch_mode, count(*) AS due FROM state WHERE is_active AND next_run_at <= {Q.AS_OF} GROUP BY 1"""))
def due_by_mode(spark, d):
    return W.due_counts(V.state(spark, d), V.as_of())


@query("f16_schedule_write_back", f"""WITH {Q.SCAN_LOG},{Q.state("TIMESTAMP '2024-01-16 00:00:00'", '_old')},{Q.watch()},
latest AS (
  SELECT target_id, arg_max(new_watch_mode, (scan_ts, event_id)) AS mode, max(scan_ts) AS scan_ts
  FROM watch WHERE ok AND scan_ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1)
SELECT s.target_id, coalesce(l.mode, watch_mode) AS watch_mode,
  {Q.ts("coalesce(date_trunc('day', l.scan_ts) + to_days(CASE l.mode WHEN 'MONTHLY' THEN 30 WHEN 'BIWEEKLY' THEN 14 WHEN 'URGENT' THEN 1 END) + INTERVAL 9 HOUR, next_run_at)")} AS next_run_at,
  {Q.ts('coalesce(l.scan_ts, last_scan_at)')} AS last_scan_at
FROM state_old s LEFT JOIN latest l ON s.target_id = CAST(l.target_id AS VARCHAR)""")
def write_back(spark, d):
    from pagetide.sources.tables import latest_per_key, partial_update

    cut = "2024-01-16 00:00:00"
    scans = V.watch_log(spark, d).filter((F.col("status") == "succeeded") & (F.col("scan_ts") >= F.lit(cut).cast("timestamp")))
    last = latest_per_key(scans.select("target_id", "scan_ts", "event_id", "new_watch_mode"), ["target_id"], ["scan_ts", "event_id"])
    updates = W.schedule_updates(last.withColumn("target_id", F.col("target_id").cast("string")))
    new, _ = partial_update(V.state(spark, d, cut), updates, ["target_id"], V.as_of())
    return plain(new.select("target_id", "watch_mode", "next_run_at", "last_scan_at"))


@query("f17_run_totals", Q.with_log("""
SELECT CAST(CAST(scan_ts AS DATE) AS VARCHAR) AS run_day, count(*) AS scanned, count(*) FILTER (status = 'succeeded') AS succeeded,
  count(*) FILTER (status = 'failed') AS failed FROM scan_log GROUP BY 1"""))
def totals(spark, d):
    return plain(W.run_totals(V.scan_log(spark, d), F.to_date("scan_ts").alias("run_day")))


@query("f18_audit_rows", Q.with_audit(f"""
SELECT sha256(target_id || ':' || event_id) AS audit_id, target_id, {Q.ts('scan_ts')} AS scan_ts, change_detected, change_type,
  coalesce(CAST(hamming_distance AS VARCHAR), 'none') AS hamming_distance, deadlines_count, previous_watch_mode, new_watch_mode,
  transition_reason, fetch_method, scan_duration_seconds, llm_api_called, email_sent
FROM audit WHERE status = 'succeeded'"""))
def success_rows(spark, d):
    rows = V.audit(spark, d).filter("status = 'succeeded'")
    rows = rows.withColumn("hamming_distance", F.coalesce(F.col("hamming_distance").cast("string"), F.lit("none")))
    return plain(rows.drop("event_id", "status"))


@query("f18_history_rows", Q.with_history(f"""
SELECT run_id, target_id, url, {Q.ts('started_at')} AS started_at, status, fetch_method, fetch_duration_ms, change_detected,
  deadlines_count, email_type FROM history WHERE status = 'succeeded'"""))
def success_history(spark, d):
    return plain(V.history(spark, d).filter("status = 'succeeded'").drop("event_id", "error_details"))


@query("f19_failure_rows", f"""WITH {Q.SCAN_LOG},{Q.watch()},{Q.AUDIT},{Q.HISTORY}
SELECT a.target_id, {Q.ts('a.scan_ts')} AS scan_ts, a.change_type, a.previous_watch_mode, a.new_watch_mode, a.transition_reason,
  a.scan_duration_seconds, a.email_sent, h.run_id, h.error_details
FROM audit a JOIN history h USING (target_id, event_id) WHERE a.status = 'failed'""")
def failure_rows(spark, d):
    """Audit and history row of a failed scan side by side: one projection, no join."""
    failed = V.watch_log(spark, d).filter("status = 'failed'")
    audit, hist = W.audit_rows(failed), W.history_rows(failed)
    left = audit.select("target_id", "event_id", "scan_ts", "change_type", "previous_watch_mode", "new_watch_mode", "transition_reason",
                        "scan_duration_seconds", "email_sent")
    return plain(left.join(hist.select("target_id", "event_id", "run_id", "error_details"), ["target_id", "event_id"]).drop("event_id"))


@query("f20_transition_text", Q.with_watch("""
SELECT event_id, 'Transition: ' || previous_watch_mode || ' → ' || new_watch_mode || chr(10) || 'Reason: ' || transition_reason || chr(10)
  || 'Change detected: ' || CASE WHEN change_detected THEN 'True' ELSE 'False' END || ' (' || change_type || ')' || chr(10)
  || 'Deadlines found: ' || deadlines_count
  || CASE WHEN deadlines_count > 0 THEN chr(10) || 'Deadline dates:' || chr(10) || array_to_string(list_transform(range(1, deadlines_count + 1),
       lambda i: '  - ' || CAST(CAST(scan_ts AS DATE) + CAST(30 * i AS INTEGER) AS VARCHAR) || ' (' || ['abstract', 'paper', 'registration'][i] || ')'), chr(10)) ELSE '' END AS summary
FROM watch WHERE ok"""))
def text_summary(spark, d):
    log = V.watch_log(spark, d).filter("status = 'succeeded'")
    found = V.deadlines_of(F.col("scan_ts"), F.col("deadlines_count"))
    return log.select("event_id", M.transition_summary(
        F.col("previous_watch_mode"), F.col("new_watch_mode"), F.col("transition_reason"), F.col("change_detected"), F.col("change_type"), found
    ).alias("summary"))
