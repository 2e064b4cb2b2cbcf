"""Sources, sinks and table upkeep (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.checks import sql as Q
from pagetide.checks.registry import plain, query
from pagetide.plans import derived as V
from pagetide.plans import monitor as R
from pagetide.sources import backup, schemas, tables, targets
from pagetide.sources.scratch import scratch_path

HALF = "2024-01-16 00:00:00"
HALF_SQL = f"TIMESTAMP '{HALF}'"


def audit_table(spark, d) -> DataFrame:
    """The derived audit rows in the shape of the audit table."""
    rows = V.audit(spark, d).withColumn("deadlines_found", V.deadlines_of(F.col("scan_ts"), F.col("deadlines_count")))
    rows = rows.withColumn("summary", F.lit(None).cast("string"))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.AUDIT.fields])


def history_table(spark, d) -> DataFrame:
    rows = V.history(spark, d).withColumn("completed_at", F.col("started_at"))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.HISTORY.fields])


def loaded_store(spark, d, *names: str) -> tables.TableStore:
    """A store in the scratch folder holding the derived tables named."""
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    store.create()
    if "state" in names:
        store.write_state(V.state(spark, d))
    if "audit" in names:
        store.append_audit(audit_table(spark, d))
    if "history" in names:
        store.append_history(history_table(spark, d))
    return store


@query("a1_page_snapshots", """
SELECT page_id, url, length(coalesce(html, '')) AS n_chars, coalesce(html, '') = '' AS is_empty FROM pages""")
def snapshots(spark, d):
    V.prepare(spark)
    return tables.read_snapshots(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"), "is_empty")


def nation_targets(spark, d) -> DataFrame:
    """Target blocks with some fields left out, one per nation."""
    return V.table(spark, d, "nation").selectExpr(
        "lower(n_name) AS target_id",
        "CASE WHEN n_nationkey % 3 > 0 THEN initcap(replace(n_name, '_', ' ')) END AS name",
        "array(concat('https://', lower(n_name), '.example.org/'), concat('https://region', n_regionkey, '.example.org/')) AS urls",
        "CASE WHEN n_regionkey = 1 THEN 'URGENT' END AS watch_mode",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'playwright' END AS fetch_mode",
        "CASE WHEN n_regionkey = 2 THEN map('cfp', array('Call for Papers', n_name), 'extra', array('Travel')) END AS keyword_groups",
    )




@query("a2_target_dimension", """
SELECT lower(n_name) AS target_id,
  CASE WHEN n_nationkey % 3 > 0 THEN 'Nation ' || split_part(n_name, '_', 2) ELSE lower(n_name) END AS name,
  'https://' || lower(n_name) || '.example.org/' AS primary_url,
  CASE WHEN n_regionkey = 1 THEN 'URGENT' ELSE 'MONTHLY' END AS watch_mode,
  CASE WHEN n_nationkey % 2 = 0 THEN 'playwright' ELSE 'auto' END AS fetch_mode,
  CASE WHEN n_regionkey = 2 THEN 'Call for Papers|' || n_name ELSE 'deadline|submission' END AS cfp_keywords,
  CASE WHEN n_regionkey = 2 THEN '' ELSE 'tba' END AS no_dates_keywords,
  CASE WHEN n_regionkey = 2 THEN 'call for papers|' || lower(n_name) || '|travel' ELSE 'deadline|submission|tba' END AS all_keywords
FROM nation""")
def dimension(spark, d):
    V.prepare(spark)
    rows = nation_targets(spark, d)
    groups = F.create_map(
        F.lit("cfp"), F.array(F.lit("deadline"), F.lit("submission")), F.lit("no_dates"), F.array(F.lit("tba"))
    )
    merged = targets.merge_targets(rows, {"watch_mode": F.lit("MONTHLY"), "fetch_mode": F.lit("auto"), "keyword_groups": groups})
    lists = [F.array_join(c, "|").alias(c) for c in ("cfp_keywords", "no_dates_keywords", "all_keywords")]
    return merged.select("target_id", "name", "primary_url", "watch_mode", "fetch_mode", *lists)


@query("a3_config_violations", """
SELECT CASE WHEN n_regionkey <> 3 THEN n_name END AS target_id, 'missing_id' AS rule FROM nation WHERE n_regionkey = 3
UNION ALL SELECT CASE WHEN n_regionkey <> 3 THEN n_name END, 'missing_urls' FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT CASE WHEN n_regionkey <> 3 THEN n_name END, 'empty_urls' FROM nation WHERE n_nationkey % 5 = 1""")
def violations(spark, d):
    rows = V.table(spark, d, "nation").selectExpr(
        "CASE WHEN n_regionkey <> 3 THEN n_name END AS target_id",
        "CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN cast(array() AS array<string>) ELSE array(n_name) END AS urls",
    )
    return targets.config_violations(rows)


@query("a4_create_and_load_tables", f"""WITH {Q.SCAN_LOG},{Q.state()}
SELECT 'state' AS table_name, (SELECT count(*) FROM state) AS row_count
UNION ALL SELECT 'audit', (SELECT count(*) FROM scan_log) UNION ALL SELECT 'history', (SELECT count(*) FROM scan_log)""")
def create(spark, d):
    store = loaded_store(spark, d, "state", "audit", "history")
    counts = [getattr(store, n)().agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n in schemas.TABLES]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("a5_state_lookup", Q.with_state(f"""
SELECT target_id, url, watch_mode, {Q.ts('next_run_at')} AS next_run_at FROM state
WHERE target_id = '7' AND url = 'https://site7.example.org/'"""))
def lookup(spark, d):
    store = loaded_store(spark, d, "state")
    found = store.state().filter((F.col("target_id") == "7") & (F.col("url") == "https://site7.example.org/"))
    return plain(found.select("target_id", "url", "watch_mode", "next_run_at"))


STATE_COLUMNS = ["target_id", "url", "watch_mode", "next_run_at", "is_active", "binary_hash", "no_change_streak", "error_streak",
                 "total_scans", "updated_at"]
STATE_SQL = f"""target_id, url, watch_mode, {Q.ts('next_run_at')} AS next_run_at, is_active, binary_hash, no_change_streak, error_streak,
  total_scans, {Q.ts('updated_at')} AS updated_at"""


@query("a6_state_scan", Q.with_state(f"SELECT {STATE_SQL} FROM state"))
def scan(spark, d):
    return plain(loaded_store(spark, d, "state").state().select(*STATE_COLUMNS))


@query("a7_upsert_state", f"""WITH {Q.SCAN_LOG},{Q.state(HALF_SQL, '_old')},{Q.state(Q.AS_OF, '_new')},
incoming AS (SELECT * FROM state_new WHERE updated_at >= {HALF_SQL} AND total_scans > 0)
SELECT {STATE_SQL} FROM incoming
UNION ALL SELECT {STATE_SQL} FROM state_old WHERE target_id NOT IN (SELECT target_id FROM incoming)""")
def upsert(spark, d):
    """The state of mid-month brought up to date with the targets scanned since."""
    incoming = V.state(spark, d).filter((F.col("updated_at") >= F.lit(HALF).cast("timestamp")) & (F.col("total_scans") > 0))
    return plain(tables.upsert(V.state(spark, d, HALF), incoming, ["target_id"]).select(*STATE_COLUMNS))


@query("a8_partial_update", Q.with_state(f"""
, upd AS (
  SELECT CAST(p_partkey AS VARCHAR) AS target_id, CASE WHEN p_size < 10 THEN 'URGENT' WHEN p_size < 30 THEN 'BIWEEKLY' ELSE 'MONTHLY' END AS mode,
    p_size AS streak FROM part)
SELECT s.target_id, coalesce(u.mode, s.watch_mode) AS watch_mode, coalesce(u.streak, s.error_streak) AS error_streak, url,
  {Q.ts(f"CASE WHEN u.target_id IS NULL THEN s.updated_at ELSE {Q.AS_OF} END")} AS updated_at, 'kept' AS outcome
FROM state s LEFT JOIN upd u USING (target_id)
UNION ALL SELECT target_id, NULL, NULL, NULL, NULL, 'missing' FROM upd WHERE target_id NOT IN (SELECT target_id FROM state)"""))
def partial(spark, d):
    """Updates from the part table; its keys past the targets match no row."""
    updates = V.table(spark, d, "part").selectExpr(
        "cast(p_partkey AS string) AS target_id",
        "CASE WHEN p_size < 10 THEN 'URGENT' WHEN p_size < 30 THEN 'BIWEEKLY' ELSE 'MONTHLY' END AS watch_mode",
        "cast(p_size AS bigint) AS error_streak", "p_brand AS no_such_column",
    )
    new, missing = tables.partial_update(V.state(spark, d), updates, ["target_id"], V.as_of())
    kept = plain(new.select("target_id", "watch_mode", "error_streak", "url", "updated_at")).withColumn("outcome", F.lit("kept"))
    nothing = {c: F.lit(None).cast(kept.schema[c].dataType) for c in ("watch_mode", "error_streak", "url", "updated_at")}
    return kept.unionByName(missing.withColumns(nothing).withColumn("outcome", F.lit("missing")))


@query("a9_append_audit", Q.with_audit(f"""
SELECT CAST(target_id AS VARCHAR) AS target_id, {Q.ts('scan_ts')} AS scan_ts, CAST(CAST(scan_ts AS DATE) AS VARCHAR) AS day, change_type,
  deadlines_count, new_watch_mode, transition_reason FROM audit"""))
def append_audit(spark, d):
    """Appended in two batches, read back with the day partition."""
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    rows = audit_table(spark, d)
    early = F.col("scan_ts") < F.lit(HALF).cast("timestamp")
    store.append_audit(rows.filter(early))
    store.append_audit(rows.filter(~early))
    return plain(store.audit().select(
        "target_id", "scan_ts", "day", "change_type", F.size("deadlines_found").alias("deadlines_count"), "new_watch_mode", "transition_reason"
    ))


@query("a10_append_history", Q.with_history(f"""
SELECT run_id, CAST(target_id AS VARCHAR) AS target_id, {Q.ts('started_at')} AS started_at, CAST(CAST(started_at AS DATE) AS VARCHAR) AS day,
  status, email_type, error_details FROM history"""))
def append_history(spark, d):
    store = loaded_store(spark, d, "history")
    return plain(store.history().select("run_id", "target_id", "started_at", "day", "status", "email_type", "error_details"))


@query("a11_ad_hoc_sql", f"""WITH {Q.SCAN_LOG},{Q.state()},{Q.HISTORY}
SELECT s.watch_mode, h.status, count(*) AS scans FROM history h JOIN state s ON s.target_id = CAST(h.target_id AS VARCHAR)
WHERE s.is_active GROUP BY 1, 2""")
def ad_hoc(spark, d):
    store = loaded_store(spark, d, "state", "history")
    return store.query(
        "SELECT s.watch_mode, h.status, count(*) AS scans FROM history h JOIN state s USING (target_id) WHERE s.is_active GROUP BY 1, 2"
    )


@query("a12_json_backup", Q.with_state("""
SELECT target_id, strftime(next_run_at, '%Y-%m-%dT%H:%M:%S.%f') AS next_run_at, watch_mode, len(current_deadlines) AS n_deadlines FROM state"""))
def json_backup(spark, d):
    """The backup files read as plain text fields, to see what was written."""
    path = scratch_path(spark, "backup")
    backup.export_json(loaded_store(spark, d, "state").state(), path)
    raw = spark.read.schema("target_id string, next_run_at string, watch_mode string, current_deadlines array<struct<date string>>").json(path)
    return raw.select("target_id", "next_run_at", "watch_mode", F.size("current_deadlines").alias("n_deadlines"))


@query("a13_restore_twice", f"""WITH {Q.SCAN_LOG},{Q.state(HALF_SQL, '_old')},{Q.state(Q.AS_OF, '_new')}
SELECT {STATE_SQL} FROM state_new""")
def restore(spark, d):
    """A backup of today restored over the state of mid-month, two times."""
    path = scratch_path(spark, "backup")
    columns = schemas.STATE.fieldNames()
    backup.export_json(V.state(spark, d).select(*columns), path)
    once = backup.restore(V.state(spark, d, HALF).select(*columns), path, "state")
    return plain(backup.restore(once, path, "state").select(*STATE_COLUMNS))


@query("a14_nested_json", Q.with_state("""
SELECT target_id, CASE WHEN len(current_deadlines) = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(current_deadlines,
    lambda x: '{"date":"' || x.date || '","type":"' || x.type || '","confidence":0.9,"source_text":"' || x.source_text || '"}'), ',') || ']' END AS as_text,
  len(current_deadlines) AS n_back, coalesce(CAST(list_max(list_transform(current_deadlines, lambda x: x.date)) AS VARCHAR), 'none') AS last_date FROM state"""))
def nested(spark, d):
    state = V.state(spark, d).withColumn("as_text", schemas.list_to_json(F.col("current_deadlines"), schemas.DEADLINES))
    back = schemas.list_from_json(F.col("as_text"), schemas.DEADLINES)
    last = F.array_max(F.transform(back, lambda x: x["date"]))
    return state.select("target_id", "as_text", F.size(back).alias("n_back"), F.coalesce(last.cast("string"), F.lit("none")).alias("last_date"))


@query("a15_row_counts", f"""WITH {Q.SCAN_LOG},{Q.state()}
SELECT 'targets' AS table_name, count(*) AS row_count FROM state UNION ALL SELECT 'active_targets', count(*) FROM state WHERE is_active
UNION ALL SELECT 'audit', count(*) FROM scan_log UNION ALL SELECT 'history', count(*) FROM scan_log""")
def row_counts(spark, d):
    return R.table_counts(V.state(spark, d), V.audit(spark, d), V.history(spark, d))


@query("a16_state_changes", f"""WITH {Q.SCAN_LOG},{Q.state(HALF_SQL, '_old')},{Q.state(Q.AS_OF, '_new')}
SELECT coalesce(o.target_id, n.target_id) AS target_id,
  CASE WHEN o.target_id IS NULL THEN 'insert' WHEN n.target_id IS NULL THEN 'delete' ELSE 'update' END AS change,
  o.watch_mode AS old_mode, n.watch_mode AS new_mode
FROM (SELECT * FROM state_old WHERE total_scans > 0) o FULL OUTER JOIN (SELECT * FROM state_new WHERE error_streak = 0 AND total_scans > 0) n USING (target_id)
WHERE o.target_id IS NULL OR n.target_id IS NULL
  OR (o.watch_mode, o.binary_hash, o.error_streak, o.total_scans) IS DISTINCT FROM (n.watch_mode, n.binary_hash, n.error_streak, n.total_scans)""")
def changes(spark, d):
    """From the scanned targets of mid-month to today's scanned ones without errors."""
    columns = ["target_id", "watch_mode", "binary_hash", "error_streak", "total_scans"]
    old = V.state(spark, d, HALF).filter("total_scans > 0").select(*columns)
    new = V.state(spark, d).filter("error_streak = 0 AND total_scans > 0").select(*columns)
    feed = tables.change_feed(old, new, ["target_id"])
    return feed.select("target_id", "change", F.col("old_row.watch_mode").alias("old_mode"), F.col("new_row.watch_mode").alias("new_mode"))
