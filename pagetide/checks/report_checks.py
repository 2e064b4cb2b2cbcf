"""Run reports (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import plain, query
from pagetide.functions import modes as M
from pagetide.operators import report as R
from pagetide.operators import watch as W
from pagetide.plans import derived as V

# A run is one day of the scan log.  Known deadlines are those of the last
# scan that found some; a summary is made for every other change.
SCANS = f"""WITH {Q.SCAN_LOG},{Q.watch()},
scans AS (
  SELECT *, strftime(scan_ts, '%Y-%m-%d') AS run_id, 'Target ' || target_id AS name,
    date_trunc('day', scan_ts) + to_days(CASE new_watch_mode WHEN 'MONTHLY' THEN 30 WHEN 'BIWEEKLY' THEN 14 ELSE 1 END) AS next_run_at,
    CASE WHEN NOT change_detected THEN 'NO_CHANGE' WHEN deadlines_count > 0 THEN 'CHANGE_WITH_DATES' ELSE 'CHANGE_NO_DATES' END AS section,
    last_value(CASE WHEN ok AND deadlines_count > 0 THEN {{'ts': scan_ts, 'n': deadlines_count}} END IGNORE NULLS)
      OVER (PARTITION BY target_id ORDER BY scan_ts, event_id ROWS UNBOUNDED PRECEDING) AS known
  FROM watch)"""

ENTRIES = SCANS + """,
entries AS (
  SELECT run_id, section FROM scans WHERE ok
  UNION ALL SELECT run_id, 'ERROR' FROM scans WHERE NOT ok AND (error_streak = 1 OR error_streak % 7 = 0))"""

LABELS = "CASE section WHEN 'CHANGE_WITH_DATES' THEN 1 WHEN 'CHANGE_NO_DATES' THEN 2 WHEN 'ERROR' THEN 3 ELSE 4 END"


def day_list(ts: str, n: str) -> str:
    return (f"coalesce(array_to_string(list_transform(range(1, {n} + 1), lambda i: strftime(CAST({ts} AS DATE) + CAST(30 * i AS INTEGER), '%B %d, %Y') "
            f"|| '/' || ['abstract', 'paper', 'registration'][i]), '; '), '')")


def scans(spark, d):
    log = W.carry_forward(V.scan_log(spark, d).withColumn("found", F.expr(
        "CASE WHEN status = 'succeeded' AND deadlines_count > 0 THEN struct(scan_ts AS ts, deadlines_count AS n) END")), ["found"])
    rows = W.watch_history(log)
    return rows.select(
        "*", F.date_format("scan_ts", "yyyy-MM-dd").alias("run_id"), F.concat(F.lit("Target "), F.col("target_id").cast("string")).alias("name"),
        M.next_run(F.col("new_watch_mode"), F.col("scan_ts")).alias("next_run_at"),
        V.deadlines_of(F.col("scan_ts"), F.col("deadlines_count")).alias("deadlines_found"),
        V.deadlines_of(F.col("known_found.ts"), F.col("known_found.n")).alias("current_deadlines"),
        F.expr("CASE WHEN llm_api_called THEN concat('First part of ', event_id, '.\n\n \n\n second part\n\n') END").alias("summary"),
    )


def entries(spark, d):
    """Report entries of the successes and of the failures due an alert."""
    rows = scans(spark, d)
    good = R.report_entries(rows.filter("status = 'succeeded'")).select("run_id", "section")
    return good.unionByName(R.error_entries(rows.filter("status = 'failed'")).select("run_id", "section"))


def shown(column, *fields):
    return F.array_join(F.transform(column, lambda x: F.concat_ws("/", *[x[f] for f in fields])), "; ")


@query("g1_report_entries", SCANS + f"""
SELECT run_id, target_id, section, name, url, strftime(scan_ts, '%Y-%m-%d %H:%M UTC') AS scan_date,
  strftime(next_run_at, '%Y-%m-%d %H:%M UTC') AS next_run_date, new_watch_mode AS watch_mode, previous_watch_mode,
  CASE WHEN deadlines_count > 0 THEN {day_list('scan_ts', 'deadlines_count')} ELSE '' END AS deadlines,
  {day_list('known.ts', 'known.n')} AS last_known_deadlines, CASE WHEN change_detected THEN change_type ELSE 'none' END AS change_type
FROM scans WHERE ok""")
def report_entries(spark, d):
    out = R.report_entries(scans(spark, d).filter("status = 'succeeded'")).drop("summary")
    return out.withColumn("deadlines", shown("deadlines", "date", "type")).withColumn(
        "last_known_deadlines", F.coalesce(shown("last_known_deadlines", "date", "type"), F.lit("")))


@query("g2_report_sections", ENTRIES + f"""
SELECT run_id, section, count(*) AS entries, {LABELS} AS rank FROM entries GROUP BY 1, 2""")
def sections(spark, d):
    return R.section_counts(entries(spark, d))


@query("g3_report_subjects", ENTRIES + f""",
c AS (SELECT run_id, section, {LABELS} AS r, count(*) AS n FROM entries GROUP BY 1, 2)
SELECT run_id, ['🚨', '⚠️', '⚠️', '✓'][min(r)] || ' Scan report: '
  || string_agg(n || ' ' || ['deadlines published', 'updated', 'error', 'no change'][r], ', ' ORDER BY r) AS subject FROM c GROUP BY 1""")
def subjects(spark, d):
    return R.report_subjects(entries(spark, d))


@query("g4_error_entries", SCANS + """
SELECT run_id, target_id, 'ERROR' AS section, name, url, error_message, error_streak FROM scans
WHERE NOT ok AND (error_streak = 1 OR error_streak % 7 = 0)""")
def error_entries(spark, d):
    return R.error_entries(scans(spark, d).filter("status = 'failed'"))


@query("g4_reported_audit", SCANS + """
, deliveries AS (SELECT run_id, count(*) % 2 = 0 AS sent FROM scans GROUP BY 1)
SELECT event_id, run_id, ok AND sent AS email_sent FROM scans JOIN deliveries USING (run_id)""")
def reported(spark, d):
    """Whether a run's mail went out is taken from the parity of its size."""
    rows = V.scan_log(spark, d).withColumn("run_id", F.date_format("scan_ts", "yyyy-MM-dd"))
    deliveries = rows.groupBy("run_id").agg((F.count(F.lit(1)) % 2 == 0).alias("sent"))
    return R.mark_reported(rows, deliveries).select("event_id", "run_id", "email_sent")


@query("g5_summary_paragraphs", Q.with_log("""
SELECT event_id, '<p>First part of ' || event_id || '.</p>' || chr(10) || '<p>second part</p>' AS summary FROM scan_log WHERE llm_api_called"""))
def paragraphs(spark, d):
    rows = V.scan_log(spark, d).filter("llm_api_called")
    text = F.concat(F.lit("First part of "), F.col("event_id").cast("string"), F.lit(".\n\n \n\n second part\n\n"))
    return rows.select("event_id", R.summary_paragraphs(text).alias("summary"))
