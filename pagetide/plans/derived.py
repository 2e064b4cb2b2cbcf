"""Views over the test tables that stand in for a scan log, state and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import modes as M
from pagetide.operators import watch
from pagetide.sources import schemas

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def prepare(spark: SparkSession) -> None:
    """Settings every plan here relies on: UTC, and timestamps with that zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_from_events(events: DataFrame) -> DataFrame:
    """One scan per event; works on a table and on a stream."""
    return events.selectExpr(
        "event_id",
        "user_id AS target_id",
        "ts AS scan_ts",
        "concat('https://site', user_id, '.example.org/') AS url",
        "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status",
        "event_type IN ('purchase', 'click') AS change_detected",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 'FILTERED' ELSE 'NONE' END AS change_type",
        "CASE WHEN event_type = 'purchase' THEN 1 + event_id % 3 ELSE 0 END AS deadlines_count",
        "CASE WHEN event_id % 4 = 0 THEN 'playwright' ELSE 'requests' END AS fetch_method",
        "event_type IN ('purchase', 'click') AND event_id % 2 = 0 AS llm_api_called",
        "event_type <> 'error' AS email_sent",
        "value AS scan_duration_seconds",
        "CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN event_id % 6 END AS hamming_distance",
        "CASE WHEN event_type = 'error' THEN concat('fetch failed for scan ', event_id) END AS error_message",
    )


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from_events(table(spark, sf_dir, "events"))


def deadlines_of(scan_ts: Column, count: Column) -> Column:
    """The deadline list of a scan that found `count` of them."""
    kinds = F.array(F.lit("abstract"), F.lit("paper"), F.lit("registration"))

    def one(i: Column) -> Column:
        kind = F.element_at(kinds, i.cast("int"))
        return F.struct(
            F.date_add(F.to_date(scan_ts), (i * 30).cast("int")).alias("date"),
            kind.alias("type"),
            F.lit(0.9).alias("confidence"),
            F.concat(F.initcap(kind), F.lit(" deadline")).alias("source_text"),
        )

    found = F.transform(F.sequence(F.lit(1).cast("bigint"), count.cast("bigint")), one)
    return F.when(count > 0, found).otherwise(schemas.empty_list(schemas.DEADLINES))


def watch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.watch_history(scan_log(spark, sf_dir))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.audit_rows(watch_log(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history rows need nothing from earlier scans, hence no window."""
    return watch.history_rows(scan_log(spark, sf_dir))


def state_from_log(log: DataFrame, customers: DataFrame, now: Column) -> DataFrame:
    """State after all scans of `log`; customers without a scan are new targets."""
    scans = watch.watch_history(log)
    ok = F.col("status") == "succeeded"
    order = F.struct("scan_ts", "event_id")
    per_target = scans.groupBy("target_id").agg(
        F.max_by(F.struct("new_watch_mode", "no_change_streak", "error_streak", "error_message", "scan_ts"), order).alias("l"),
        F.max_by(F.struct("scan_ts", "event_id"), F.when(ok, order)).alias("s"),
        F.max_by(F.struct("scan_ts", "deadlines_count"), F.when(ok & (F.col("deadlines_count") > 0), order)).alias("d"),
        F.max("scans_so_far").alias("total_scans"),
    )
    named = customers.select(F.col("c_custkey").alias("target_id"), F.col("c_name").alias("name"))
    joined = per_target.join(named, "target_id", "full_outer")
    mode = F.coalesce("l.new_watch_mode", F.lit("MONTHLY"))
    number = F.col("target_id").cast("string")
    version = F.concat_ws(":", number, F.col("s.event_id").cast("string"))
    return joined.select(
        number.alias("target_id"),
        F.coalesce("name", F.concat(F.lit("Target "), number)).alias("name"),
        F.concat(F.lit("https://site"), number, F.lit(".example.org/")).alias("url"),
        mode.alias("watch_mode"),
        F.coalesce(M.next_run(mode, F.col("s.scan_ts")), now).alias("next_run_at"),
        F.col("s.scan_ts").alias("last_scan_at"),
        (F.col("target_id") % 10 != 9).alias("is_active"),
        F.when(F.col("s").isNotNull(), F.sha2(F.concat(F.lit("page:"), version), 256)).alias("binary_hash"),
        F.when(F.col("s").isNotNull(), F.sha2(F.concat(F.lit("text:"), version), 256)).alias("filtered_hash"),
        (F.col("s.event_id") * 2654435761).alias("simhash"),
        F.coalesce(deadlines_of(F.col("d.scan_ts"), F.col("d.deadlines_count")), schemas.empty_list(schemas.DEADLINES)).alias("current_deadlines"),
        F.lit(None).cast("string").alias("current_summary"),
        schemas.empty_list(schemas.LINKS).alias("tracked_links"),
        F.coalesce("l.no_change_streak", F.lit(0)).cast("bigint").alias("no_change_streak"),
        F.coalesce("l.error_streak", F.lit(0)).cast("bigint").alias("error_streak"),
        F.coalesce("total_scans", F.lit(0)).cast("bigint").alias("total_scans"),
        F.when(F.col("l.error_streak") > 0, F.col("l.error_message")).alias("last_error"),
        F.coalesce("l.scan_ts", now).alias("updated_at"),
    )


def state(spark: SparkSession, sf_dir: str, until: str = AS_OF) -> DataFrame:
    """State as it stood at `until`, seen from the fixed as-of time."""
    log = scan_log(spark, sf_dir).filter(F.col("scan_ts") < F.lit(until).cast("timestamp"))
    return state_from_log(log, table(spark, sf_dir, "customer"), F.lit(until).cast("timestamp"))


def snapshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new html per page: same, noise only, content, first scan, comment only."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url",
        "CASE WHEN page_id % 5 = 3 THEN NULL ELSE html END AS old_html",
        """CASE WHEN page_id % 5 = 1 THEN replace(html, '<nav>', '<nav>v2 ')
                WHEN page_id % 5 = 2 THEN replace(html, '</article>', '<p>Updated notice.</p></article>')
                WHEN page_id % 5 = 4 THEN concat(html, '<!-- v2 -->') ELSE html END AS new_html""",
    )


def deadline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_id", "o_custkey AS target_id", "o_orderdate",
        """concat(CASE o_orderkey % 6
             WHEN 0 THEN 'Abstract submission deadline: ' WHEN 1 THEN 'Full paper deadline: '
             WHEN 2 THEN 'Early bird registration closes: ' WHEN 3 THEN 'Camera-ready due: '
             WHEN 4 THEN 'Last updated: ' ELSE 'Submit your proposal by ' END,
           date_format(o_orderdate, 'MMMM d, yyyy')) AS sentence""",
    )


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS pos", "p_partkey % 20 AS seed_id",
        """concat('https://conf', cast(p_partkey % 20 AS string), '.example.org/',
             CASE p_partkey % 8 WHEN 0 THEN 'cfp' WHEN 1 THEN 'submit/abstract' WHEN 2 THEN 'important-dates'
               WHEN 3 THEN '2026/programme' WHEN 4 THEN 'call-for-papers.pdf' WHEN 5 THEN 'donate' ELSE 'about' END,
             '?p=', cast(p_size AS string), '#x') AS href""",
        """CASE p_partkey % 8 WHEN 0 THEN 'Call for Papers' WHEN 1 THEN 'Submit abstract' WHEN 2 THEN 'Key dates'
             WHEN 4 THEN 'Call for papers 2026' ELSE p_name END AS text""",
    )
