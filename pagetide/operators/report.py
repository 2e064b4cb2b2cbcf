"""Run report: entries, sections, subject line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import modes as M
from pagetide.functions.html import collapse_ends

# Section, icon, label; most important first.
SECTIONS = (
    ("CHANGE_WITH_DATES", "🚨", "deadlines published"),
    ("CHANGE_NO_DATES", "⚠️", "updated"),
    ("ERROR", "⚠️", "error"),
    ("NO_CHANGE", "✓", "no change"),
)
REPORT_TITLE = "Scan report"
STAMP = "yyyy-MM-dd HH:mm 'UTC'"
LONG_DATE = "MMMM dd, yyyy"


def section_rank(section: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s, _, _ in SECTIONS]), section).cast("int")


def _of_section(section: Column, part: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for row in SECTIONS for x in (row[0], row[part])]), section)


def summary_paragraphs(summary: Column) -> Column:
    """Paragraphs split at blank lines, each wrapped, empty ones dropped."""
    parts = F.filter(F.transform(F.split(summary, "\n\n"), collapse_ends), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")


def long_dates(deadlines: Column, with_source: bool) -> Column:
    def entry(d: Column) -> Column:
        fields = [F.date_format(d["date"], LONG_DATE).alias("date"), d["type"].alias("type")]
        if with_source:
            fields += [d["confidence"].alias("confidence"), d["source_text"].alias("source_text")]
        return F.struct(*fields)

    return F.transform(deadlines, entry)


def report_entries(scans: DataFrame) -> DataFrame:
    """One entry per successful scan, with everything the report shows.

    Needs name, url, scan_ts, next_run_at, modes, change columns, the arrays
    deadlines_found and current_deadlines, and summary.
    """
    n = F.size("deadlines_found")
    return scans.select(
        "run_id", "target_id",
        M.notification_class(F.col("change_detected"), n).alias("section"),
        "name", "url",
        F.date_format("scan_ts", STAMP).alias("scan_date"),
        F.date_format("next_run_at", STAMP).alias("next_run_date"),
        F.col("new_watch_mode").alias("watch_mode"), "previous_watch_mode",
        long_dates(F.col("deadlines_found"), True).alias("deadlines"),
        long_dates(F.col("current_deadlines"), False).alias("last_known_deadlines"),
        F.when(F.col("summary") != "", summary_paragraphs(F.col("summary"))).alias("summary"),
        F.when(F.col("change_detected"), F.col("change_type")).otherwise(F.lit("none")).alias("change_type"),
    )


def error_entries(failures: DataFrame) -> DataFrame:
    """Failed scans that are due an alert: the first and every 7th of a streak."""
    return failures.filter(M.alert_due(F.col("error_streak"))).select(
        "run_id", "target_id", F.lit("ERROR").alias("section"), "name", "url", "error_message", "error_streak"
    )


def section_counts(entries: DataFrame) -> DataFrame:
    """(run_id, section, rank, entries) - aggregated before any shuffle."""
    return entries.groupBy("run_id", "section").agg(F.count(F.lit(1)).alias("entries")).withColumn(
        "rank", section_rank(F.col("section"))
    )


def ordered_entries(entries: DataFrame) -> DataFrame:
    """Entries with the rank of their section, as a report shows them: by run, section and target."""
    return entries.withColumn("rank", section_rank(F.col("section"))).orderBy("run_id", "rank", "target_id")


def report_subjects(entries: DataFrame) -> DataFrame:
    """(run_id, subject): icon of the first section present, then the counts."""
    counted = section_counts(entries).withColumn(
        "_part", F.struct("rank", "section", F.concat_ws(" ", F.col("entries").cast("string"), _of_section(F.col("section"), 2)).alias("text"))
    )
    ordered = counted.groupBy("run_id").agg(F.array_sort(F.collect_list("_part")).alias("parts"))
    icon = _of_section(F.col("parts")[0]["section"], 1)
    return ordered.select(
        "run_id",
        F.concat(icon, F.lit(f" {REPORT_TITLE}: "), F.array_join(F.transform("parts", lambda p: p["text"]), ", ")).alias("subject"),
    )


def mark_reported(audit: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Audit rows with `email_sent` set from their run's delivery.

    `deliveries` has run_id and sent.  Failed scans are never marked: their
    audit row is written when they fail.
    """
    joined = audit.drop("email_sent").join(deliveries, "run_id", "left")
    sent = (F.col("status") == "succeeded") & F.coalesce("sent", F.lit(False))
    return joined.withColumn("email_sent", sent).drop("sent")
