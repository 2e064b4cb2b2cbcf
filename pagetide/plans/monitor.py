"""Monitoring reports over the state, audit and history tables.

Averages are taken over exact decimals: a sum of doubles depends on the order
in which partial results arrive and may round differently after a retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import modes as M

USD_PER_CALL = 0.02


def exact_avg(column: str, digits: int) -> Column:
    return F.round(F.avg(F.col(column).cast("decimal(18,6)")), digits).cast("double")


def percent(part: Column, digits: int | None = None) -> Column:
    share = F.try_divide(F.lit(100.0) * part, F.count(F.lit(1)))
    return share if digits is None else F.round(share, digits)


def days_back(as_of: Column, days: int) -> Column:
    """Midnight at the start of the day, `days` ago."""
    return F.date_sub(F.to_date(as_of), days).cast("timestamp")


def since(rows: DataFrame, column: str, start: Column) -> DataFrame:
    """Rows from `start` on.  Of a log kept by day only the days that can hold them are read.

    The days were cut in the time zone of the session that wrote them, which may be two dates off at most.
    """
    found = rows.filter(F.col(column) >= start)
    return found.filter(F.col("day") >= F.date_sub(F.to_date(start), 2)) if "day" in rows.columns else found


def _flag(name: str) -> Column:
    return F.count_if(F.col(name))


def reported_state(state: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The stored state as the reports read it: with the target's name, its id if `targets` (target_id, name) has none."""
    if "name" in state.columns:
        return state
    if targets is None:
        return state.withColumn("name", F.col("target_id"))
    named = state.join(targets.select("target_id", "name"), "target_id", "left")
    return named.withColumn("name", F.coalesce("name", "target_id"))


def reported_audit(audit: DataFrame) -> DataFrame:
    """The stored audit rows as the reports read them: with event_id, status and the number of deadlines found.

    Rows of late pages are no scans and are left out.
    """
    if "status" in audit.columns:
        return audit
    reason = F.coalesce("transition_reason", F.lit(""))
    return audit.filter(reason != "LATE").withColumns({
        "event_id": F.col("audit_id"),
        "status": F.when(reason.startswith("SCAN_FAILED"), "failed").otherwise("succeeded"),
        "deadlines_count": F.coalesce(F.size("deadlines_found"), F.lit(0)),
    })


def state_overview(state: DataFrame, as_of: Column) -> DataFrame:
    n = F.size("current_deadlines")
    return state.select(
        "target_id", "name", "watch_mode", "next_run_at", "last_scan_at",
        F.datediff(as_of, "last_scan_at").alias("days_since_scan"),
        n.alias("deadline_count"), "no_change_streak",
        F.when(F.col("binary_hash").isNull(), "Not Scanned").when(n > 0, "Has Deadlines").otherwise("No Deadlines").alias("status"),
    ).orderBy(F.desc(M.mode_rank(F.col("watch_mode"))), "next_run_at", "target_id")


def mode_distribution(state: DataFrame) -> DataFrame:
    return state.groupBy("watch_mode").agg(
        F.count(F.lit(1)).alias("target_count"), exact_avg("no_change_streak", 1).alias("avg_no_change_streak")
    ).orderBy(F.desc(M.mode_rank(F.col("watch_mode"))))


def deadline_listing(state: DataFrame, as_of: Column) -> DataFrame:
    return state.select("target_id", "name", F.explode("current_deadlines").alias("d")).select(
        "target_id", "name", F.col("d.date").alias("deadline_date"), F.col("d.type").alias("deadline_type"),
        F.col("d.confidence").alias("confidence"), F.datediff("d.date", as_of).alias("days_until_deadline"),
    ).orderBy("deadline_date", "target_id")


def daily_activity(audit: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return since(audit, "scan_ts", days_back(as_of, days)).groupBy(F.to_date("scan_ts").alias("scan_date")).agg(
        F.count(F.lit(1)).alias("total_scans"), _flag("change_detected").alias("changes_detected"),
        F.count_if(F.col("deadlines_count") > 0).alias("deadlines_found"), _flag("email_sent").alias("emails_sent"),
        _flag("llm_api_called").alias("llm_calls"), exact_avg("scan_duration_seconds", 2).alias("avg_duration_sec"),
    ).orderBy(F.desc("scan_date"))


def target_summary(audit: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return since(audit, "scan_ts", days_back(as_of, days)).groupBy("target_id").agg(
        F.count(F.lit(1)).alias("total_scans"), _flag("change_detected").alias("changes_detected"),
        F.count_if(F.col("deadlines_count") > 0).alias("scans_with_deadlines"), F.max("scan_ts").alias("last_scan"),
        exact_avg("scan_duration_seconds", 2).alias("avg_duration_sec"),
    ).orderBy("target_id")


def transitions(audit: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    moved = F.col("previous_watch_mode") != F.col("new_watch_mode")
    return since(audit, "scan_ts", days_back(as_of, days)).filter(moved).select(
        "target_id", "scan_ts", "previous_watch_mode", "new_watch_mode", "transition_reason", "change_type", "deadlines_count"
    ).orderBy(F.desc("scan_ts"))


def change_breakdown(audit: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return since(audit, "scan_ts", days_back(as_of, days)).groupBy("change_type").agg(
        F.count(F.lit(1)).alias("scans"), exact_avg("hamming_distance", 1).alias("avg_hamming_distance")
    ).orderBy(F.desc("scans"))


def llm_usage(audit: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    calls = _flag("llm_api_called")
    return since(audit, "scan_ts", days_back(as_of, days)).agg(
        F.count(F.lit(1)).alias("total_scans"), calls.alias("llm_calls"), percent(calls, 1).alias("llm_call_percentage"),
        F.round(calls * USD_PER_CALL, 2).alias("estimated_cost_usd"),
    )


def delivery_rate(audit: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Over all scans, and over successes only: failures never send a mail."""
    sent, ok = _flag("email_sent"), F.count_if(F.col("status") == "succeeded")
    return since(audit, "scan_ts", days_back(as_of, days)).agg(
        F.count(F.lit(1)).alias("total_scans"), sent.alias("emails_sent"), percent(sent, 1).alias("success_rate"),
        F.when(ok > 0, F.round(100.0 * sent / ok, 1)).alias("success_rate_of_scanned"),
    )


def recent_errors(history: DataFrame, as_of: Column, days: int = 7, limit: int = 10) -> DataFrame:
    return since(history, "started_at", days_back(as_of, days)).filter("status = 'failed'").select(
        "run_id", "target_id", "started_at", "status", "error_details"
    ).orderBy(F.desc("started_at")).limit(limit)


def scan_performance(audit: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return since(audit, "scan_ts", days_back(as_of, days)).groupBy("target_id").agg(
        F.count(F.lit(1)).alias("scan_count"), exact_avg("scan_duration_seconds", 2).alias("avg_duration"),
        F.round(F.min("scan_duration_seconds"), 2).alias("min_duration"), F.round(F.max("scan_duration_seconds"), 2).alias("max_duration"),
        F.when(F.bool_or(F.coalesce(F.col("fetch_method") == "playwright", F.lit(False))), "Yes").otherwise("No").alias("used_playwright"),
    ).orderBy(F.desc("avg_duration"))


def stale_targets(state: DataFrame, as_of: Column, days: int = 35) -> DataFrame:
    age = F.datediff(as_of, "last_scan_at")
    return state.filter(age > days).select("target_id", "last_scan_at", age.alias("days_stale"))


def stuck_urgent(state: DataFrame, streak: int = 10) -> DataFrame:
    return state.filter((F.col("watch_mode") == "URGENT") & (F.col("no_change_streak") > streak)).select("target_id", "no_change_streak")


def delivery_alert(audit: DataFrame, as_of: Column, days: int = 7, tolerated: int = 5) -> DataFrame:
    """One row if more deliveries failed than tolerated, else none."""
    return since(audit, "scan_ts", days_back(as_of, days)).agg(F.count_if(~F.col("email_sent")).alias("failure_count")).filter(
        F.col("failure_count") > tolerated
    )


_LATEST = ("target_id", "event_id", "scan_ts", "change_detected", "change_type", "new_watch_mode", "email_sent", "scan_duration_seconds")


def latest_scans(audit: DataFrame, limit: int = 10) -> DataFrame:
    return audit.select(*_LATEST).orderBy(F.desc("scan_ts"), F.desc("event_id")).limit(limit)


def latest_scan_per_target(audit: DataFrame) -> DataFrame:
    """By aggregate, so that a target with most of the rows shrinks before the shuffle."""
    rest = [c for c in _LATEST if c != "target_id"]
    return audit.groupBy("target_id").agg(F.max_by(F.struct(*rest), F.struct("scan_ts", "event_id")).alias("r")).select("target_id", "r.*")


def baseline_flags(state: DataFrame) -> DataFrame:
    return state.select(
        "target_id", "watch_mode", "next_run_at", F.col("binary_hash").isNull().alias("is_first_scan"),
        F.col("binary_hash").isNotNull().alias("has_baseline"), F.size("current_deadlines").alias("deadline_count"),
    ).orderBy("target_id")


def recent_scans(audit: DataFrame, start: Column) -> DataFrame:
    return since(audit, "scan_ts", start).select(
        "target_id", "event_id", "scan_ts", "change_detected", "new_watch_mode", "email_sent", "scan_duration_seconds"
    ).orderBy(F.desc("scan_ts"))


def failures_since(history: DataFrame, start: Column) -> DataFrame:
    return since(history, "started_at", start).filter("status = 'failed'").select("target_id", "started_at", "status", "error_details")


def llm_calls_since(audit: DataFrame, start: Column) -> DataFrame:
    return since(audit, "scan_ts", start).agg(F.count(F.lit(1)).alias("total_scans"), _flag("llm_api_called").alias("llm_calls"))


def weekly_summary(audit: DataFrame, start: Column) -> DataFrame:
    return since(audit, "scan_ts", start).agg(
        F.countDistinct(F.to_date("scan_ts")).alias("days_active"), F.count(F.lit(1)).alias("total_scans"),
        _flag("change_detected").alias("changes_detected"), F.count_if(F.col("deadlines_count") > 0).alias("deadlines_discovered"),
        _flag("email_sent").alias("emails_sent"), exact_avg("scan_duration_seconds", 2).alias("avg_scan_duration"),
    )


def slow_scans(audit: DataFrame) -> DataFrame:
    return audit.groupBy("target_id").agg(
        exact_avg("scan_duration_seconds", 6).alias("avg_duration"), F.max("scan_duration_seconds").alias("max_duration")
    ).orderBy(F.desc("avg_duration"))


def fetch_methods(audit: DataFrame) -> DataFrame:
    return audit.groupBy("target_id", "fetch_method").agg(F.count(F.lit(1)).alias("scans"))


def llm_percentage(audit: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    calls = _flag("llm_api_called")
    return since(audit, "scan_ts", days_back(as_of, days)).agg(
        F.count(F.lit(1)).alias("total_scans"), calls.alias("llm_calls"), percent(calls).alias("llm_call_percentage")
    )


def latest_failures(history: DataFrame, limit: int = 10) -> DataFrame:
    return history.filter("status = 'failed'").select("target_id", "started_at", "error_details").orderBy(F.desc("started_at")).limit(limit)


def fingerprints_of(state: DataFrame, target_id: str) -> DataFrame:
    return state.filter(F.col("target_id") == target_id).select("target_id", "binary_hash", "filtered_hash", "simhash")


def table_counts(state: DataFrame, audit: DataFrame, history: DataFrame) -> DataFrame:
    """(table_name, row_count): targets, active targets, audit and history rows."""
    by_state = state.agg(F.count(F.lit(1)).alias("targets"), F.count_if("is_active").alias("active_targets"))
    unpivoted = by_state.selectExpr("stack(2, 'targets', targets, 'active_targets', active_targets) AS (table_name, row_count)")
    counted = [
        rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, rows in (("audit", audit), ("history", history))
    ]
    return unpivoted.unionByName(counted[0]).unionByName(counted[1])


def _band(value: Column, good: Column, warning: Column) -> Column:
    return F.when(good, "good").when(warning, "warning").otherwise("critical")


def health_bands(audit: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(metric, value, band) of five figures of the last days."""
    calls = _flag("llm_api_called")
    ok = F.count_if(F.col("status") == "succeeded")
    figures = since(audit, "scan_ts", days_back(as_of, days)).agg(
        exact_avg("scan_duration_seconds", 4).alias("scan_duration"),
        F.when(ok > 0, F.round(100.0 * _flag("email_sent") / ok, 4)).alias("email_delivery"),
        F.round(calls / F.lit(float(days)), 4).alias("llm_calls_per_day"),
        F.round(calls * USD_PER_CALL / F.lit(float(days)), 4).alias("daily_cost"),
        percent(ok, 4).alias("success_rate"),
    )
    return banded(figures)


def banded(figures: DataFrame) -> DataFrame:
    """(metric, value, band) of a row of the five figures."""
    rows = figures.selectExpr(
        "stack(5, 'scan_duration', scan_duration, 'email_delivery', email_delivery, 'llm_calls_per_day', llm_calls_per_day,"
        " 'daily_cost', daily_cost, 'success_rate', success_rate) AS (metric, value)"
    )
    v, m = F.col("value"), F.col("metric")
    band = (
        F.when(m == "scan_duration", _band(v, v < 30, v <= 60))
        .when(m == "llm_calls_per_day", _band(v, v <= 2, v <= 5))
        .when(m == "daily_cost", _band(v, v < 5, v <= 10))
        .otherwise(_band(v, v >= 100, v > 95))
    )
    return rows.withColumn("band", band)
