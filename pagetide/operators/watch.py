"""Watch state of each target: modes, streaks, schedule, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import modes as M
from pagetide.operators.running import Running, running, sliced_running, slices, time_chunk

ORDER = ("scan_ts", "event_id")


def watch_history(log: DataFrame, chunk_seconds: int | None = 3600, start: DataFrame | None = None) -> DataFrame:
    """Scan log plus the target's watch state before and after every scan.

    `log` has target_id, event_id, scan_ts, status, change_detected and
    deadlines_count.  Adds is_baseline, previous_watch_mode, new_watch_mode,
    transition_reason, no_change_streak, error_streak and scans_so_far.

    `start` is the state the log begins from: target_id, watch_mode,
    no_change_streak, error_streak and has_baseline, one row per target.
    Targets it lacks, or all of them without it, begin as new ones.

    A mode only ever rises, so it is a running maximum of outcome ranks.  A
    streak is a running count less its value at the last reset, and that value
    is again a running maximum.  Both add up over time chunks, so that no task
    has to hold all scans of one target (see `running`).  With
    `chunk_seconds=None` the log is cut into slices of equal size instead, for
    a backfill whose scans share few times; that writes a checkpoint.
    """
    keys = ["target_id", "_chunk"]
    ok = F.col("status") == "succeeded"
    changed = ok & F.col("change_detected")
    quiet = ok & ~F.col("change_detected")
    inside = Window.partitionBy(*keys).orderBy(*ORDER)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    def count_of(condition: Column) -> Column:
        return F.sum(condition.cast("bigint"))

    if chunk_seconds is None:
        chunked = slices(log, keys[:1], ORDER, out="_chunk")
    else:
        chunked = log.withColumn("_chunk", time_chunk(F.col("scan_ts"), chunk_seconds))
    rows = (
        chunked
        .withColumn("_rank", M.outcome_rank(changed, F.col("deadlines_count")))
        .withColumn("_rank_b", F.max("_rank").over(before))
        .withColumn("_q", count_of(quiet).over(upto))
        .withColumn("_f", count_of(~ok).over(upto))
        .withColumn("_s", count_of(ok).over(upto))
        .withColumn("_fq", F.first(F.when(ok, quiet.cast("bigint")), ignorenulls=True).over(upto))
        .withColumn("_qr", F.max(F.when(changed, F.col("_q"))).over(upto))
        .withColumn("_fr", F.max(F.when(ok, F.col("_f"))).over(upto))
    )
    totals = rows.groupBy(*keys).agg(
        F.max("_rank").alias("rank"), F.max("_q").alias("q"), F.max("_f").alias("f"), F.max("_s").alias("s"),
        F.max("_fq").alias("fq"), F.max("_qr").alias("qr"), F.max("_fr").alias("fr"),
    )
    earlier = Window.partitionBy("target_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def carried(column: str) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    offsets = (
        totals.withColumn("o_q", carried("q")).withColumn("o_f", carried("f")).withColumn("o_s", carried("s"))
        .select(
            *keys, "o_q", "o_f", "o_s",
            F.max("rank").over(earlier).alias("o_rank"),
            F.first("fq", ignorenulls=True).over(earlier).alias("o_fq"),
            F.max(F.col("o_q") + F.col("qr")).over(earlier).alias("o_qr"),
            F.max(F.col("o_f") + F.col("fr")).over(earlier).alias("o_fr"),
        )
    )
    joined = rows.join(offsets, keys)
    zero = F.lit(0)
    rank0, quiet0, failed0, known = zero, zero, zero, F.lit(False)
    if start is not None:
        joined = joined.join(start.select(
            "target_id", M.mode_rank(F.col("watch_mode")).alias("_rank0"), F.col("no_change_streak").alias("_quiet0"),
            F.col("error_streak").alias("_failed0"), F.col("has_baseline").alias("_known"),
        ), "target_id", "left")
        rank0, quiet0, failed0 = (F.coalesce(c, zero) for c in ("_rank0", "_quiet0", "_failed0"))
        known = F.coalesce("_known", F.lit(False))
    old_rank = F.greatest(F.coalesce("o_rank", zero), F.coalesce("_rank_b", zero), rank0)
    new_rank = F.greatest(old_rank, F.col("_rank"))
    # The running count at the last reset; NULL before the first one.
    changed_at = F.greatest(F.col("o_qr"), F.col("o_q") + F.col("_qr"))
    baseline_at = F.when(~known, F.coalesce("o_fq", "_fq"))
    success_at = F.greatest(F.col("o_fr"), F.col("o_f") + F.col("_fr"))
    staged = joined.select(
        *log.columns,
        (ok & ~known & (F.col("o_s") + F.col("_s") == 1)).alias("is_baseline"),
        M.mode_name(old_rank).alias("previous_watch_mode"),
        M.mode_name(new_rank).alias("new_watch_mode"),
        (F.col("o_q") + F.col("_q") - F.coalesce(F.greatest(changed_at, baseline_at), -quiet0)).alias("no_change_streak"),
        (F.col("o_f") + F.col("_f") - F.coalesce(success_at, -failed0)).alias("error_streak"),
        (F.col("o_s") + F.col("_s")).alias("scans_so_far"),
    )
    reason = F.when(ok, M.transition_reason(F.col("previous_watch_mode"), F.col("change_detected"), F.col("deadlines_count")))
    return staged.withColumn("transition_reason", reason)


def carry_forward(log: DataFrame, columns: list[str], chunk_seconds: int | None = 3600) -> DataFrame:
    """Adds known_<column>: the last non-empty value of the target so far.

    `chunk_seconds=None` cuts by slices of equal size, see `watch_history`.
    """
    measures = [Running(f"known_{c}", "last", F.col(c)) for c in columns]
    if chunk_seconds is None:
        return sliced_running(log, ["target_id"], list(ORDER), measures)
    return running(log, ["target_id"], list(ORDER), time_chunk(F.col("scan_ts"), chunk_seconds), measures)


def due_targets(state: DataFrame, as_of: Column, force: bool = False) -> DataFrame:
    active = state.filter("is_active")
    return active if force else active.filter(F.col("next_run_at") <= as_of)


def by_priority(state: DataFrame) -> DataFrame:
    """URGENT, BIWEEKLY, MONTHLY, then the earliest run."""
    return state.orderBy(F.desc(M.mode_rank(F.col("watch_mode"))), "next_run_at", "target_id")


def due_counts(state: DataFrame, as_of: Column) -> DataFrame:
    return due_targets(state, as_of).groupBy("watch_mode").agg(F.count(F.lit(1)).alias("due"))


def scan_summary(state: DataFrame, as_of: Column) -> DataFrame:
    """One row: active targets by due time (buckets do not overlap) and by mode."""
    late = F.col("next_run_at") <= as_of
    today = F.col("next_run_at") <= as_of + F.expr("INTERVAL 1 DAY")
    week = F.col("next_run_at") <= as_of + F.expr("INTERVAL 7 DAYS")
    return state.filter("is_active").agg(
        F.count(F.lit(1)).alias("total_active"),
        F.count_if(late).alias("overdue"),
        F.count_if(~late & today).alias("today"),
        F.count_if(~today & week).alias("this_week"),
        *[F.count_if(F.col("watch_mode") == m).alias(m.lower()) for m in M.MODES],
    )


def reconcile(state: DataFrame, targets: DataFrame, as_of: Column) -> DataFrame:
    """State after a look at the target list, with the `action` taken.

    New targets start MONTHLY and due at once; targets no longer listed go
    inactive and come back when listed again; a changed url clears the three
    fingerprints.  `targets` has target_id and primary_url.
    """
    listed = targets.select("target_id", "primary_url").withColumn("_listed", F.lit(True))
    joined = state.withColumn("_known", F.lit(True)).join(listed, "target_id", "full_outer")
    known, is_listed = F.coalesce("_known", F.lit(False)), F.coalesce("_listed", F.lit(False))
    moved = known & is_listed & (comparable_url(F.col("url")) != comparable_url(F.col("primary_url")))
    active = F.coalesce("is_active", F.lit(False))
    new_values = {
        "url": F.when(~known | moved, F.col("primary_url")).otherwise(F.col("url")),
        "watch_mode": F.when(known, F.col("watch_mode")).otherwise(F.lit("MONTHLY")),
        "next_run_at": F.when(known, F.col("next_run_at")).otherwise(as_of),
        "is_active": is_listed,
    }
    for column in ("binary_hash", "filtered_hash", "simhash"):
        new_values[column] = F.when(~moved, F.col(column))
    for column in ("no_change_streak", "error_streak", "total_scans"):
        new_values[column] = F.coalesce(column, F.lit(0))
    action = F.concat_ws(
        ",",
        F.when(~known, F.lit("inserted")),
        F.when(moved, F.lit("url_changed")),
        F.when(known & active & ~is_listed, F.lit("deactivated")),
        F.when(known & ~active & is_listed, F.lit("reactivated")),
    )
    columns = [new_values[c].alias(c) if c in new_values else F.col(c) for c in state.columns]
    return joined.select(*columns, action.alias("action"))


def comparable_url(url: Column) -> Column:
    """Lower-case scheme and host, and '/' for an empty path."""
    head = F.lower(F.regexp_extract(url, r"^([^/?#]*//[^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*(.*)$", 1)
    return F.concat(head, F.when(rest == "", F.lit("/")).otherwise(rest))


def schedule_updates(scans: DataFrame, hour: int = 9, minute: int = 0) -> DataFrame:
    """(target_id, watch_mode, next_run_at, last_scan_at) to write back after scans."""
    return scans.select(
        "target_id", F.col("new_watch_mode").alias("watch_mode"),
        M.next_run(F.col("new_watch_mode"), F.col("scan_ts"), hour, minute).alias("next_run_at"),
        F.col("scan_ts").alias("last_scan_at"),
    )


def run_totals(log: DataFrame, *keys: Column) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


ERROR_CHARS = 1000


def audit_rows(history: DataFrame) -> DataFrame:
    """Audit rows of successes and failures from scans with their watch state.

    A failed scan is no change, keeps the mode, and says why in its reason.
    Needs `error_message` besides the columns of `watch_history`.
    """
    ok = F.col("status") == "succeeded"
    failure = F.substring(F.concat(F.lit("SCAN_FAILED: "), F.col("error_message")), 1, ERROR_CHARS)
    return history.select(
        F.sha2(F.concat_ws(":", F.col("target_id").cast("string"), F.col("event_id").cast("string")), 256).alias("audit_id"),
        "target_id", "event_id", "scan_ts", "status",
        (ok & F.col("change_detected")).alias("change_detected"),
        F.when(ok, F.col("change_type")).otherwise(F.lit("NONE")).alias("change_type"),
        F.when(ok, F.col("hamming_distance")).alias("hamming_distance"),
        F.when(ok, F.col("deadlines_count")).otherwise(0).alias("deadlines_count"),
        "previous_watch_mode",
        F.when(ok, F.col("new_watch_mode")).otherwise(F.col("previous_watch_mode")).alias("new_watch_mode"),
        F.when(ok, F.col("transition_reason")).otherwise(failure).alias("transition_reason"),
        F.when(ok, F.col("fetch_method")).alias("fetch_method"),
        F.when(ok, F.col("scan_duration_seconds")).otherwise(F.lit(0).cast(history.schema["scan_duration_seconds"].dataType)).alias("scan_duration_seconds"),
        (ok & F.col("llm_api_called")).alias("llm_api_called"),
        (ok & F.col("email_sent")).alias("email_sent"),
    )


def history_rows(history: DataFrame) -> DataFrame:
    """Scan-history rows of successes and failures; `run_id` names the scan."""
    ok = F.col("status") == "succeeded"
    return history.select(
        F.sha2(F.concat_ws("#", F.col("target_id").cast("string"), F.col("event_id").cast("string")), 256).alias("run_id"),
        "target_id", "event_id", "url", F.col("scan_ts").alias("started_at"), "status",
        F.when(ok, F.col("fetch_method")).alias("fetch_method"),
        F.when(ok, F.floor(F.col("scan_duration_seconds") * 1000).cast("bigint")).alias("fetch_duration_ms"),
        F.when(ok, F.col("change_detected")).alias("change_detected"),
        F.when(ok, F.col("deadlines_count")).alias("deadlines_count"),
        F.when(ok, M.notification_class(F.col("change_detected"), F.col("deadlines_count"))).alias("email_type"),
        F.when(~ok, F.col("error_message")).alias("error_details"),
    )
