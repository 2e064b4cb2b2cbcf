"""Monitoring reports (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import SQL, plain, query
from pagetide.plans import derived as V
from pagetide.plans import monitor as R
from pagetide.plans import rollup

DAYS_7 = "TIMESTAMP '2024-01-24 00:00:00'"
DAYS_30 = "TIMESTAMP '2024-01-01 00:00:00'"
HOURS_24 = "TIMESTAMP '2024-01-30 00:00:00'"
MINUTES = "TIMESTAMP '2024-01-30 23:50:00'"


def avg(column: str, digits: int) -> str:
    """Average over exact decimals, halves rounded up."""
    scale = 10 ** digits
    total = f"sum(CAST({column} AS DECIMAL(18,6)))"
    return f"CAST(floor(CAST({total} AS DOUBLE) * {scale} / count({column}) + 0.5 + 1e-9) / {scale} AS DOUBLE)"


def flag(column: str) -> str:
    return f"count(*) FILTER ({column})"


def percent(part: str, digits: int) -> str:
    return f"round(100.0::DOUBLE * {part} / count(*), {digits})"


def back(hours: float = 0):
    return V.as_of() - F.make_dt_interval(hours=F.lit(hours))


@query("h1_state_overview", Q.with_state(f"""
SELECT target_id, name, watch_mode, {Q.ts('next_run_at')} AS next_run_at, {Q.ts('last_scan_at')} AS last_scan_at,
  coalesce(CAST(date_diff('day', CAST(last_scan_at AS DATE), CAST({Q.AS_OF} AS DATE)) AS VARCHAR), 'never') AS days_since_scan,
  len(current_deadlines) AS deadline_count, no_change_streak,
  CASE WHEN binary_hash IS NULL THEN 'Not Scanned' WHEN len(current_deadlines) > 0 THEN 'Has Deadlines' ELSE 'No Deadlines' END AS status
FROM state"""))
def overview(spark, d):
    out = R.state_overview(V.state(spark, d), V.as_of())
    return plain(out.withColumn("days_since_scan", F.coalesce(F.col("days_since_scan").cast("string"), F.lit("never"))))


@query("h2_mode_distribution", Q.with_state(f"""
SELECT watch_mode, count(*) AS target_count, {avg('no_change_streak', 1)} AS avg_no_change_streak FROM state GROUP BY 1"""))
def modes(spark, d):
    return R.mode_distribution(V.state(spark, d))


@query("h3_deadline_listing", Q.with_state(f"""
SELECT target_id, name, CAST(x.date AS VARCHAR) AS deadline_date, x.type AS deadline_type, x.confidence AS confidence,
  date_diff('day', CAST({Q.AS_OF} AS DATE), x.date) AS days_until_deadline
FROM (SELECT target_id, name, unnest(current_deadlines) AS x FROM state)"""))
def listing(spark, d):
    return plain(R.deadline_listing(V.state(spark, d), V.as_of()))


@query("h4_daily_activity", Q.with_audit(f"""
SELECT CAST(CAST(scan_ts AS DATE) AS VARCHAR) AS scan_date, count(*) AS total_scans, {flag('change_detected')} AS changes_detected,
  {flag('deadlines_count > 0')} AS deadlines_found, {flag('email_sent')} AS emails_sent, {flag('llm_api_called')} AS llm_calls,
  {avg('scan_duration_seconds', 2)} AS avg_duration_sec FROM audit WHERE scan_ts >= {DAYS_7} GROUP BY 1"""))
def activity(spark, d):
    return plain(R.daily_activity(V.audit(spark, d), V.as_of()))


@query("h5_target_summary", Q.with_audit(f"""
SELECT target_id, count(*) AS total_scans, {flag('change_detected')} AS changes_detected, {flag('deadlines_count > 0')} AS scans_with_deadlines,
  {Q.ts('max(scan_ts)')} AS last_scan, {avg('scan_duration_seconds', 2)} AS avg_duration_sec
FROM audit WHERE scan_ts >= {DAYS_30} GROUP BY 1"""))
def per_target(spark, d):
    return plain(R.target_summary(V.audit(spark, d), V.as_of()))


@query("h6_transitions", Q.with_audit(f"""
SELECT target_id, {Q.ts('scan_ts')} AS scan_ts, previous_watch_mode, new_watch_mode, transition_reason, change_type, deadlines_count
FROM audit WHERE scan_ts >= {DAYS_30} AND previous_watch_mode <> new_watch_mode"""))
def moved(spark, d):
    return plain(R.transitions(V.audit(spark, d), V.as_of()))


@query("h7_change_breakdown", Q.with_audit(f"""
SELECT change_type, count(*) AS scans, {avg('hamming_distance', 1)} AS avg_hamming_distance
FROM audit WHERE scan_ts >= {DAYS_30} GROUP BY 1"""))
def breakdown(spark, d):
    return R.change_breakdown(V.audit(spark, d), V.as_of())


@query("h8_llm_usage", Q.with_audit(f"""
SELECT count(*) AS total_scans, {flag('llm_api_called')} AS llm_calls, {percent(flag('llm_api_called'), 1)} AS llm_call_percentage,
  round({flag('llm_api_called')} * 0.02::DOUBLE, 2) AS estimated_cost_usd FROM audit WHERE scan_ts >= {DAYS_30}"""))
def usage(spark, d):
    return R.llm_usage(V.audit(spark, d), V.as_of())


@query("h9_delivery_rate", Q.with_audit(f"""
SELECT count(*) AS total_scans, {flag('email_sent')} AS emails_sent, {percent(flag('email_sent'), 1)} AS success_rate,
  round(100.0::DOUBLE * {flag('email_sent')} / {flag("status = 'succeeded'")}, 1) AS success_rate_of_scanned
FROM audit WHERE scan_ts >= {DAYS_30}"""))
def delivery(spark, d):
    return R.delivery_rate(V.audit(spark, d), V.as_of())


@query("h10_recent_errors", Q.with_history(f"""
SELECT run_id, target_id, {Q.ts('started_at')} AS started_at, status, error_details FROM history
WHERE started_at >= {DAYS_7} AND status = 'failed' ORDER BY history.started_at DESC LIMIT 10"""))
def errors(spark, d):
    return plain(R.recent_errors(V.history(spark, d), V.as_of()))


@query("h11_scan_performance", Q.with_audit(f"""
SELECT target_id, count(*) AS scan_count, {avg('scan_duration_seconds', 2)} AS avg_duration, round(min(scan_duration_seconds), 2) AS min_duration,
  round(max(scan_duration_seconds), 2) AS max_duration, max(CASE WHEN fetch_method = 'playwright' THEN 'Yes' ELSE 'No' END) AS used_playwright
FROM audit WHERE scan_ts >= {DAYS_7} GROUP BY 1"""))
def performance(spark, d):
    return R.scan_performance(V.audit(spark, d), V.as_of())


STALE_AS_OF = "TIMESTAMP '2024-03-05 12:00:00'"


@query("h12_stale_targets", Q.with_state(f"""
SELECT target_id, {Q.ts('last_scan_at')} AS last_scan_at,
  date_diff('day', CAST(last_scan_at AS DATE), DATE '2024-03-05') AS days_stale FROM state
WHERE last_scan_at IS NOT NULL AND date_diff('day', CAST(last_scan_at AS DATE), DATE '2024-03-05') > 35"""))
def stale(spark, d):
    """Seen five weeks on, so that part of the targets have gone stale."""
    return plain(R.stale_targets(V.state(spark, d), F.lit("2024-03-05 12:00:00").cast("timestamp")))


@query("h13_stuck_urgent", Q.with_state("""
SELECT target_id, no_change_streak FROM state WHERE watch_mode = 'URGENT' AND no_change_streak > 3"""))
def stuck(spark, d):
    """With a streak of 3, which the test log reaches; the default is 10."""
    return R.stuck_urgent(V.state(spark, d), 3)


@query("h14_delivery_alert", Q.with_audit(f"""
SELECT {flag('NOT email_sent')} AS failure_count FROM audit WHERE scan_ts >= {DAYS_7} HAVING {flag('NOT email_sent')} > 5"""))
def delivery_alert(spark, d):
    return R.delivery_alert(V.audit(spark, d), V.as_of())


LATEST = f"target_id, event_id, {Q.ts('scan_ts')} AS scan_ts, change_detected, change_type, new_watch_mode, email_sent, scan_duration_seconds"


@query("h15_latest_scans", Q.with_audit(f"SELECT {LATEST} FROM audit ORDER BY audit.scan_ts DESC, event_id DESC LIMIT 10"))
def latest(spark, d):
    return plain(R.latest_scans(V.audit(spark, d)))


@query("h15_latest_scan_per_target", Q.with_audit(f"""
SELECT {LATEST} FROM audit QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY audit.scan_ts DESC, event_id DESC) = 1"""))
def latest_each(spark, d):
    return plain(R.latest_scan_per_target(V.audit(spark, d)))


@query("h16_baseline_flags", Q.with_state(f"""
SELECT target_id, watch_mode, {Q.ts('next_run_at')} AS next_run_at, binary_hash IS NULL AS is_first_scan,
  binary_hash IS NOT NULL AS has_baseline, len(current_deadlines) AS deadline_count FROM state"""))
def baseline(spark, d):
    return plain(R.baseline_flags(V.state(spark, d)))


@query("h17_scans_last_day", Q.with_audit(f"""
SELECT target_id, event_id, {Q.ts('scan_ts')} AS scan_ts, change_detected, new_watch_mode, email_sent, scan_duration_seconds
FROM audit WHERE scan_ts >= {HOURS_24}"""))
def last_day(spark, d):
    return plain(R.recent_scans(V.audit(spark, d), back(24)))


@query("h17_scans_last_minutes", Q.with_audit(f"""
SELECT target_id, event_id, {Q.ts('scan_ts')} AS scan_ts, change_detected, new_watch_mode, email_sent, scan_duration_seconds
FROM audit WHERE scan_ts >= {MINUTES}"""))
def last_minutes(spark, d):
    return plain(R.recent_scans(V.audit(spark, d), V.as_of() - F.expr("INTERVAL 10 MINUTES")))


@query("h17_errors_last_day", Q.with_history(f"""
SELECT target_id, {Q.ts('started_at')} AS started_at, status, error_details FROM history
WHERE started_at >= {HOURS_24} AND status = 'failed'"""))
def errors_last_day(spark, d):
    return plain(R.failures_since(V.history(spark, d), back(24)))


@query("h18_llm_calls_last_day", Q.with_audit(f"""
SELECT count(*) AS total_scans, {flag('llm_api_called')} AS llm_calls FROM audit WHERE scan_ts >= {HOURS_24}"""))
def calls_last_day(spark, d):
    return R.llm_calls_since(V.audit(spark, d), back(24))


@query("h19_weekly_summary", Q.with_audit(f"""
SELECT count(DISTINCT CAST(scan_ts AS DATE)) AS days_active, count(*) AS total_scans, {flag('change_detected')} AS changes_detected,
  {flag('deadlines_count > 0')} AS deadlines_discovered, {flag('email_sent')} AS emails_sent, {avg('scan_duration_seconds', 2)} AS avg_scan_duration
FROM audit WHERE scan_ts >= {DAYS_7}"""))
def weekly(spark, d):
    return R.weekly_summary(V.audit(spark, d), back(24 * 7))


@query("h20_slow_scans", Q.with_audit(f"""
SELECT target_id, {avg('scan_duration_seconds', 6)} AS avg_duration, max(scan_duration_seconds) AS max_duration FROM audit GROUP BY 1"""))
def slow(spark, d):
    return R.slow_scans(V.audit(spark, d))


@query("h21_fetch_methods", Q.with_audit("SELECT target_id, fetch_method, count(*) AS scans FROM audit GROUP BY 1, 2"))
def methods(spark, d):
    return R.fetch_methods(V.audit(spark, d))


@query("h22_llm_percentage", Q.with_audit(f"""
SELECT count(*) AS total_scans, {flag('llm_api_called')} AS llm_calls,
  100.0::DOUBLE * {flag('llm_api_called')} / count(*) AS llm_call_percentage FROM audit WHERE scan_ts >= {DAYS_30}"""))
def llm_share(spark, d):
    return R.llm_percentage(V.audit(spark, d), V.as_of())


@query("h23_latest_failures", Q.with_history(f"""
SELECT target_id, {Q.ts('started_at')} AS started_at, error_details FROM history WHERE status = 'failed'
ORDER BY history.started_at DESC LIMIT 10"""))
def failures(spark, d):
    return plain(R.latest_failures(V.history(spark, d)))


@query("h24_fingerprint_lookup", Q.with_state("SELECT target_id, binary_hash, filtered_hash, simhash FROM state WHERE target_id = '42'"))
def lookup(spark, d):
    return R.fingerprints_of(V.state(spark, d), "42")


@query("h25_health_bands", Q.with_audit(f"""
, f AS (SELECT {avg('scan_duration_seconds', 4)} AS a, round(100.0::DOUBLE * {flag('email_sent')} / {flag("status = 'succeeded'")}, 4) AS b,
    round({flag('llm_api_called')} / 7.0::DOUBLE, 4) AS c, round({flag('llm_api_called')} * 0.02::DOUBLE / 7.0, 4) AS d,
    round(100.0::DOUBLE * {flag("status = 'succeeded'")} / count(*), 4) AS e FROM audit WHERE scan_ts >= {DAYS_7})
SELECT 'scan_duration' AS metric, a AS value, CASE WHEN a < 30 THEN 'good' WHEN a <= 60 THEN 'warning' ELSE 'critical' END AS band FROM f
UNION ALL SELECT 'email_delivery', b, CASE WHEN b >= 100 THEN 'good' WHEN b > 95 THEN 'warning' ELSE 'critical' END FROM f
UNION ALL SELECT 'llm_calls_per_day', c, CASE WHEN c <= 2 THEN 'good' WHEN c <= 5 THEN 'warning' ELSE 'critical' END FROM f
UNION ALL SELECT 'daily_cost', d, CASE WHEN d < 5 THEN 'good' WHEN d <= 10 THEN 'warning' ELSE 'critical' END FROM f
UNION ALL SELECT 'success_rate', e, CASE WHEN e >= 100 THEN 'good' WHEN e > 95 THEN 'warning' ELSE 'critical' END FROM f"""))
def health(spark, d):
    return R.health_bands(V.audit(spark, d), V.as_of())


# the same reports from the daily table of partial aggregates
ROLLED = {
    "h4_daily_activity": rollup.daily_activity, "h5_target_summary": rollup.target_summary, "h7_change_breakdown": rollup.change_breakdown,
    "h8_llm_usage": rollup.llm_usage, "h9_delivery_rate": rollup.delivery_rate, "h11_scan_performance": rollup.scan_performance,
    "h14_delivery_alert": rollup.delivery_alert, "h19_weekly_summary": rollup.weekly_summary, "h22_llm_percentage": rollup.llm_percentage,
    "h25_health_bands": rollup.health_bands,
}


def _rolled(report):
    return lambda spark, d: plain(report(rollup.partials(V.audit(spark, d)), V.as_of()))


for _name, _report in ROLLED.items():
    query(f"{_name}_rolled", SQL[_name])(_rolled(_report))
