"""One scan over a batch of page snapshots, as a single plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import hashing as X
from pagetide.functions import modes as M
from pagetide.operators import deadlines as D
from pagetide.operators import fingerprints as P
from pagetide.operators import text as T
from pagetide.operators.running import Running, running, time_chunk
from pagetide.operators.watch import ERROR_CHARS, watch_history
from pagetide.sources import schemas
from pagetide.sources.scratch import cut

STORED_TEXT_CHARS = 5000


def changed_pages(pairs: DataFrame, key: str = "page_id", threshold: int = P.THRESHOLD) -> DataFrame:
    """Which pages changed, and how, from pairs of old and new html.

    Pages with equal html are decided by one hash each.  Only the others are
    cleaned and fingerprinted, both versions in one pass.
    """
    old_hash, new_hash = X.sha256_hex(F.col("old_html")), X.sha256_hex(F.col("new_html"))
    same = F.coalesce(old_hash == new_hash, F.lit(False))
    unchanged = pairs.filter(same).select(
        key, F.lit(False).alias("change_detected"), F.lit("NONE").alias("change_type"), F.lit(None).cast("int").alias("hamming_distance")
    )
    versions = pairs.filter(~same).select(
        key, F.inline(F.array(
            F.struct(F.lit("new").alias("version"), F.col("new_html").alias("html")),
            F.struct(F.lit("old").alias("version"), F.col("old_html").alias("html")),
        )),
    ).filter("html IS NOT NULL")
    tagged = versions.withColumn("vid", F.concat_ws(":", F.col(key).cast("string"), F.col("version")))
    hashed = tagged.select(key, "vid", "version", X.sha256_hex(F.col("html")).alias("binary_hash"))
    texts = T.filtered_text(tagged, "vid")
    signed = P.simhash(
        texts.select("vid", "filtered_text", X.sha256_hex(F.col("filtered_text")).alias("filtered_hash")), ["vid", "filtered_hash"], "filtered_text"
    )
    prints = hashed.join(signed, "vid").drop("vid")
    new = prints.filter("version = 'new'").drop("version")
    old = prints.filter("version = 'old'").drop("version")
    found = P.detect_changes(new, old, key, threshold)
    return unchanged.unionByName(found.select(*unchanged.columns))


@dataclass(frozen=True)
class ScanTables:
    """What a scan adds: `state` rows to upsert, `audit` and `history` rows to append."""

    state: DataFrame
    audit: DataFrame
    history: DataFrame


SNAPSHOT = ["target_id", "scan_ts"]


def on_time(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """Snapshots newer than their target's last scan; time does not run backwards."""
    return _against_last(snapshots, state).filter("_last IS NULL OR scan_ts > _last").drop("_last")


def late_audit(snapshots: DataFrame, state: DataFrame, run_id: Column) -> DataFrame:
    """Audit rows of snapshots older than their target's last scan; one of the same time is a redelivery and gets none."""
    late = _against_last(snapshots.select(*SNAPSHOT, "fetch_method"), state).filter("scan_ts < _last")
    known = {
        "audit_id": scan_key(run_id), "target_id": F.col("target_id"), "scan_ts": F.col("scan_ts"), "fetch_method": F.col("fetch_method"),
        "change_detected": F.lit(False), "change_type": F.lit("NONE"), "deadlines_found": schemas.empty_list(schemas.DEADLINES),
        "transition_reason": F.lit("LATE"), "scan_duration_seconds": F.lit(0.0), "llm_api_called": F.lit(False), "email_sent": F.lit(False),
    }
    return late.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.AUDIT.fields))


def _against_last(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    return snapshots.join(state.select("target_id", F.col("last_scan_at").alias("_last")), "target_id", "left")


def scan_key(run_id: Column) -> Column:
    """Identity of one scan of a run."""
    return F.sha2(F.concat_ws(":", run_id, "target_id", F.unix_micros("scan_ts").cast("string")), 256)


def scan_batch(
    snapshots: DataFrame,
    state: DataFrame,
    keywords: Column,
    run_id: Column,
    threshold: int = P.THRESHOLD,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Scan results: one row per snapshot with its decision and next watch state.

    `snapshots` follows the snapshot schema and may carry `error`; a snapshot
    with an error is a failed scan; `fetch_duration_ms` is how long it took.  A target may have any number of them, at
    different times: each is compared to the one before it, the first to
    `state`.  This is done for all at once, with running values over time
    chunks, so a target that fills much of the batch is spread over tasks.

    A snapshot whose html is that of the one before keeps its fingerprints and
    is not cleaned.  The texts of the others are written to the checkpoint
    folder, as three later steps read them.  `keywords` are in lower case.
    """
    error = F.col("error") if "error" in snapshots.columns else F.lit(None).cast("string")
    took = F.col("fetch_duration_ms") if "fetch_duration_ms" in snapshots.columns else F.lit(None).cast("bigint")
    pages = snapshots.select(
        *SNAPSHOT, "url", "fetch_method", error.alias("error"), took.alias("fetch_duration_ms"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("binary_hash", F.when(F.col("error").isNull(), X.sha256_hex(F.col("html"))))
    known = state.select(
        "target_id", F.col("binary_hash").alias("first_binary"), F.col("filtered_hash").alias("first_filtered"),
        F.col("simhash").alias("first_simhash"),
    )
    scans = _with_last(pages.drop("html"), [("old_binary", F.col("binary_hash"), False)], chunk_seconds)
    scans = cut(scans.join(known, "target_id", "left").withColumn("old_binary", F.coalesce("old_binary", "first_binary")))
    changed_html = F.col("error").isNull() & ~F.coalesce(F.col("binary_hash") == F.col("old_binary"), F.lit(False))
    fresh = scans.filter(changed_html).select(*SNAPSHOT)
    sid = F.struct(*SNAPSHOT).alias("sid")
    texts = cut(T.page_texts(pages.join(fresh, SNAPSHOT).select(sid, "html"), keywords, "sid").withColumn("scan_ts", F.col("sid.scan_ts")))
    prints = P.simhash(
        texts.select("sid", "filtered_text", X.sha256_hex(F.col("filtered_text")).alias("filtered_hash")),
        ["sid", "filtered_hash"], "filtered_text",
    )
    found = D.extract_deadlines(texts, "sid", F.col("scan_ts"))
    stored = texts.select("sid", F.substring("main_text", 1, STORED_TEXT_CHARS).alias("main_text"), "snippets")
    joined = scans.withColumn("sid", sid).join(prints, "sid", "left").join(found, "sid", "left").join(stored, "sid", "left").drop("sid")
    return _watched(_decided(joined, threshold, chunk_seconds), state, run_id, chunk_seconds)


def _with_last(rows: DataFrame, columns: list[tuple[str, Column, bool]], chunk_seconds: int) -> DataFrame:
    """Adds per target the last non-NULL value of each column in time order."""
    measures = [Running(name, "last", value, inclusive) for name, value, inclusive in columns]
    return running(rows, ["target_id"], ["scan_ts"], time_chunk(F.col("scan_ts"), chunk_seconds), measures)


def _decided(scans: DataFrame, threshold: int, chunk_seconds: int) -> DataFrame:
    """Adds fingerprints, the change decision and the deadlines that count."""
    pair = F.when(F.col("filtered_hash").isNotNull(), F.struct("filtered_hash", "simhash"))
    carried = _with_last(scans, [("_now", pair, True), ("_before", pair, False)], chunk_seconds)
    first = F.when(F.col("first_filtered").isNotNull(), F.struct(F.col("first_filtered").alias("filtered_hash"), F.col("first_simhash").alias("simhash")))
    ok = F.col("error").isNull()
    scans = (
        carried.withColumn("_before", F.coalesce("_before", first))
        .withColumn("_now", F.coalesce("_now", "_before"))
        .withColumn("filtered_hash", F.when(ok, F.col("_now.filtered_hash")))
        .withColumn("simhash", F.when(ok, F.col("_now.simhash")))
        .withColumn("is_baseline", ok & F.col("old_binary").isNull())
    )
    old = {"binary_hash": F.col("old_binary"), "filtered_hash": F.col("_before.filtered_hash"), "simhash": F.col("_before.simhash")}
    verdict = P.decision(F.col("old_binary").isNotNull(), F.col, old.__getitem__, threshold)
    empty = schemas.empty_list(schemas.DEADLINES)
    judged = scans.withColumn("_v", verdict).withColumn("deadlines", F.coalesce("deadlines", empty))
    changed, kind = P.apply_baseline(F.col("is_baseline"), F.size("deadlines"), F.col("_v.change_detected"), F.col("_v.change_type"))
    return (
        judged.withColumn("change_detected", ok & changed)
        .withColumn("change_type", F.when(ok, kind).otherwise("NONE"))
        .withColumn("hamming_distance", F.when(ok & ~F.col("is_baseline"), F.col("_v.hamming_distance")))
        .withColumn("deadlines_found", F.when(F.col("change_detected"), F.col("deadlines")).otherwise(empty))
        .withColumn("deadlines_count", F.size("deadlines_found"))
        .withColumn("status", F.when(ok, "succeeded").otherwise("failed"))
        .withColumn("event_id", F.lit(0))
        .drop("_v", "_now", "_before", "deadlines", "first_binary", "first_filtered", "first_simhash", "old_binary", "is_baseline")
    )


def _watched(scans: DataFrame, state: DataFrame, run_id: Column, chunk_seconds: int) -> DataFrame:
    """Adds the watch state; a failed scan keeps the mode and the planned run."""
    start = state.select("target_id", "watch_mode", "no_change_streak", "error_streak", F.col("binary_hash").isNotNull().alias("has_baseline"))
    rows = watch_history(cut(scans), chunk_seconds, start)
    ok = F.col("status") == "succeeded"
    failure = F.substring(F.concat(F.lit("SCAN_FAILED: "), "error"), 1, ERROR_CHARS)
    return (
        rows.withColumn("transition_reason", F.when(ok, F.col("transition_reason")).otherwise(failure))
        .withColumn("next_run_at", F.when(ok, M.next_run(F.col("new_watch_mode"), F.col("scan_ts"))))
        .withColumn("run_id", run_id)
    )


def scan_tables(results: DataFrame, state: DataFrame) -> ScanTables:
    """State rows and log rows of scan results that started from `state`.

    `summary`, `llm_api_called` and `email_sent` are taken from `results` where it has them.
    """
    ok = F.col("status") == "succeeded"
    for column, missing in (("summary", F.lit(None).cast("string")), ("llm_api_called", F.lit(False)), ("email_sent", F.lit(False))):
        if column not in results.columns:
            results = results.withColumn(column, missing)
    good = F.when(ok, F.col("scan_ts"))
    per_target = results.groupBy("target_id").agg(
        F.max_by(F.struct("url", "new_watch_mode", "no_change_streak", "error_streak", "error", "scan_ts"), "scan_ts").alias("l"),
        F.max_by(F.struct("scan_ts", "next_run_at", "binary_hash", "filtered_hash", "simhash"), good).alias("s"),
        F.max_by("deadlines_found", F.when(F.size("deadlines_found") > 0, F.col("scan_ts"))).alias("found"),
        F.max_by("summary", F.when(F.col("summary") != "", F.col("scan_ts"))).alias("told"),
        F.count_if(ok).alias("scans"), F.min("scan_ts").alias("first_ts"),
    )
    rows = per_target.join(state.alias("o"), "target_id", "left")
    kept = {
        "url": F.col("l.url"),
        "watch_mode": F.col("l.new_watch_mode"),
        "next_run_at": F.coalesce("s.next_run_at", "o.next_run_at", "first_ts"),
        "last_scan_at": F.coalesce("s.scan_ts", "o.last_scan_at"),
        "is_active": F.coalesce("o.is_active", F.lit(True)),
        "current_deadlines": F.coalesce("found", "o.current_deadlines", schemas.empty_list(schemas.DEADLINES)),
        "current_summary": F.coalesce("told", "o.current_summary"),
        "tracked_links": F.coalesce("o.tracked_links", schemas.empty_list(schemas.LINKS)),
        "no_change_streak": F.col("l.no_change_streak"),
        "error_streak": F.col("l.error_streak"),
        "total_scans": F.coalesce("o.total_scans", F.lit(0)) + F.col("scans"),
        "last_error": F.substring("l.error", 1, ERROR_CHARS),
        "updated_at": F.col("l.scan_ts"),
    }
    for c in ("binary_hash", "filtered_hash", "simhash"):
        kept[c] = F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"o.{c}"))
    new_state = rows.select("target_id", *[kept[c].alias(c) for c in schemas.STATE.fieldNames() if c != "target_id"])

    scan_id = scan_key(F.col("run_id"))
    method = F.when(ok, F.col("fetch_method")).alias("fetch_method")
    audit = results.select(
        scan_id.alias("audit_id"), "target_id", "scan_ts", "change_detected", "change_type", "hamming_distance", "deadlines_found",
        "summary", "previous_watch_mode", "new_watch_mode", "transition_reason", method,
        F.coalesce(F.when(ok, F.col("fetch_duration_ms") / 1000), F.lit(0.0)).alias("scan_duration_seconds"), "llm_api_called", "email_sent",
    )
    history = results.select(
        scan_id.alias("run_id"), "target_id", "url", F.col("scan_ts").alias("started_at"), F.col("scan_ts").alias("completed_at"), "status",
        method, F.when(ok, F.col("fetch_duration_ms")).alias("fetch_duration_ms"),
        F.when(ok, F.col("change_detected")).alias("change_detected"), F.when(ok, F.col("deadlines_count")).alias("deadlines_count"),
        F.when(ok, M.notification_class(F.col("change_detected"), F.col("deadlines_count"))).alias("email_type"),
        F.when(~ok, F.col("error")).alias("error_details"),
    )
    return ScanTables(new_state, audit, history)
