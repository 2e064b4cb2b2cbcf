"""All monitoring reports on tables that a scan has filled."""

from __future__ import annotations

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from pagetide.plans import monitor as R
from pagetide.plans import rollup
from pagetide.plans.scan import scan_batch, scan_tables
from pagetide.sources import schemas
from pagetide.sources.tables import TableStore, upsert

from test_scan import CHANGED, DATES, NO_DATES, snapshots



NOW, START = "2026-02-03 12:00:00", "2026-01-20 00:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="pagetide-test-"))
    store.create()
    for day, pages in enumerate(({"alpha": NO_DATES, "beta": NO_DATES}, {"alpha": CHANGED, "beta": None}, {"alpha": DATES, "beta": NO_DATES})):
        state = store.state()
        new = scan_tables(scan_batch(snapshots(spark, day, **pages), state, F.array(F.lit("deadline")), F.lit(f"run{day}")), state)
        store.append_once(new.audit, "audit")
        store.append_once(new.history, "history")
        store.write_state(upsert(state, new.state, ["target_id"]))
    return R.reported_state(store.state()), R.reported_audit(store.audit()), store.history()


REPORTS = {
    "state_overview": lambda s, a, h: R.state_overview(s, at(NOW)), "mode_distribution": lambda s, a, h: R.mode_distribution(s),
    "deadline_listing": lambda s, a, h: R.deadline_listing(s, at(NOW)), "daily_activity": lambda s, a, h: R.daily_activity(a, at(NOW)),
    "target_summary": lambda s, a, h: R.target_summary(a, at(NOW)), "transitions": lambda s, a, h: R.transitions(a, at(NOW)),
    "change_breakdown": lambda s, a, h: R.change_breakdown(a, at(NOW)), "llm_usage": lambda s, a, h: R.llm_usage(a, at(NOW)),
    "delivery_rate": lambda s, a, h: R.delivery_rate(a, at(NOW)), "recent_errors": lambda s, a, h: R.recent_errors(h, at(NOW)),
    "scan_performance": lambda s, a, h: R.scan_performance(a, at(NOW)), "stale_targets": lambda s, a, h: R.stale_targets(s, at(NOW)),
    "stuck_urgent": lambda s, a, h: R.stuck_urgent(s), "delivery_alert": lambda s, a, h: R.delivery_alert(a, at(NOW)),
    "latest_scans": lambda s, a, h: R.latest_scans(a), "latest_scan_per_target": lambda s, a, h: R.latest_scan_per_target(a),
    "baseline_flags": lambda s, a, h: R.baseline_flags(s), "recent_scans": lambda s, a, h: R.recent_scans(a, at(START)),
    "failures_since": lambda s, a, h: R.failures_since(h, at(START)), "llm_calls_since": lambda s, a, h: R.llm_calls_since(a, at(START)),
    "weekly_summary": lambda s, a, h: R.weekly_summary(a, at(START)), "slow_scans": lambda s, a, h: R.slow_scans(a),
    "fetch_methods": lambda s, a, h: R.fetch_methods(a), "llm_percentage": lambda s, a, h: R.llm_percentage(a, at(NOW)),
    "latest_failures": lambda s, a, h: R.latest_failures(h), "fingerprints_of": lambda s, a, h: R.fingerprints_of(s, "alpha"),
    "table_counts": lambda s, a, h: R.table_counts(s, a, h), "health_bands": lambda s, a, h: R.health_bands(a, at(NOW)),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_runs_on_stored_tables(tables, name):
    rows = REPORTS[name](*tables).collect()
    assert name in ("stale_targets", "stuck_urgent", "delivery_alert") or rows
    if name == "deadline_listing":
        assert [(r["target_id"], r["name"], str(r["deadline_date"])) for r in rows] == [("alpha", "alpha", "2026-04-02")]
    if name == "health_bands":
        assert {r["metric"]: r["value"] for r in rows}["success_rate"] == pytest.approx(100 * 5 / 6, abs=1e-3)
    if name == "daily_activity":
        assert [r["total_scans"] for r in rows] == [2, 2, 2] and sum(r["deadlines_found"] for r in rows) == 1


BY_DAYS = ("daily_activity", "target_summary", "transitions", "change_breakdown", "llm_usage", "delivery_rate", "recent_errors", "scan_performance",
           "delivery_alert", "recent_scans", "failures_since", "llm_calls_since", "weekly_summary", "llm_percentage", "health_bands")


@pytest.mark.parametrize("name", BY_DAYS)
def test_report_opens_only_the_days_it_needs(tables, name):
    plan = REPORTS[name](*tables)._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert pruned and all(re.search(r"day#\d+ >= 2026-01-\d\d", x) for x in pruned), plan


@pytest.mark.parametrize("name", BY_DAYS)
def test_report_of_no_rows(tables, name):
    state, audit, history = tables
    REPORTS[name](state, audit.filter("false"), history.filter("false")).collect()


DAYS = {"daily_activity": 7, "target_summary": 30, "change_breakdown": 30, "llm_usage": 30, "delivery_rate": 30, "scan_performance": 7,
        "delivery_alert": 7, "llm_percentage": 30, "health_bands": 7}


def reports(source, audit, now):
    """Every report that both sources give, as sorted rows."""
    found = {name: getattr(source, name)(audit, at(now), days) for name, days in DAYS.items()}
    midnight = F.date_sub(F.to_date(at(now)), 7)
    found["weekly_summary"] = source.weekly_summary(audit, midnight.cast("timestamp") if source is R else at(now))
    found |= {"slow_scans": source.slow_scans(audit), "fetch_methods": source.fetch_methods(audit)}
    return {name: sorted(map(str, df.collect())) for name, df in found.items()}


def scans(spark, days, salt=0):
    """Audit rows over some days, with nulls in what may be null and several scans of a target a day."""
    rows = spark.range(days * 40).select(
        F.concat(F.lit(f"a{salt}-"), F.col("id").cast("string")).alias("audit_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("target_id"),
        (F.lit("2026-01-25 01:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") * 7 % (24 * days)).cast("int"))).alias("scan_ts"),
        (F.col("id") % 4 == 1).alias("change_detected"), F.element_at(F.array(F.lit("NONE"), F.lit("BINARY"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("change_type"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 64).cast("int")).alias("hamming_distance"), F.lit(None).alias("deadlines_found"), F.lit(None).alias("summary"),
        F.lit("MONTHLY").alias("previous_watch_mode"), F.lit("URGENT").alias("new_watch_mode"),
        F.when(F.col("id") % 11 == 0, "SCAN_FAILED: x").when(F.col("id") % 13 == 0, "LATE").otherwise("UNCHANGED").alias("transition_reason"),
        F.when(F.col("id") % 6 == 0, "playwright").when(F.col("id") % 6 == 1, "requests").alias("fetch_method"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 0.123457 + salt).alias("scan_duration_seconds"),
        F.when(F.col("id") % 9 != 0, F.col("id") % 2 == 0).alias("llm_api_called"), F.when(F.col("id") % 8 != 0, F.col("id") % 3 == 0).alias("email_sent"),
    )
    deadlines = schemas.AUDIT["deadlines_found"].dataType
    return rows.withColumns({"deadlines_found": F.when(F.col("change_detected"), F.array(F.struct(F.to_date(F.lit("2026-05-01")), F.lit("paper"), F.lit(0.5), F.lit("x")))).cast(deadlines),
                             "summary": F.col("summary").cast("string")})


def test_daily_table_gives_the_same_reports(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="pagetide-test-"))
    store.create()
    for now in (NOW, "2030-01-01 00:00:00"):
        assert reports(rollup, rollup.daily(store), now) == reports(R, R.reported_audit(store.audit()), now)
    store.append_audit(scans(spark, 10))
    want = reports(R, R.reported_audit(store.audit()), NOW)
    assert reports(rollup, rollup.daily(store), NOW) == want
    held = rollup.roll_up(store, dt.date(2026, 2, 1))
    assert held == [dt.date(2026, 1, 25) + dt.timedelta(days=k) for k in range(7)]
    assert reports(rollup, rollup.daily(store), NOW) == want
    # more rows, of held days too: the days behind them are read from the log, the others when they are redone
    store.append_audit(scans(spark, 10, salt=1))
    want = reports(R, R.reported_audit(store.audit()), NOW)
    assert reports(rollup, rollup.daily(store), NOW) != want
    assert rollup.roll_up(store, dt.date(2026, 2, 3), again_from=dt.date(2026, 1, 25)) == [*held, dt.date(2026, 2, 1), dt.date(2026, 2, 2)]
    assert reports(rollup, rollup.daily(store), NOW) == want
    assert rollup.roll_up(store, dt.date(2026, 2, 3)) == store.days(rollup.TABLE)


def test_held_days_are_not_read_from_the_log(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="pagetide-test-"))
    store.create()
    store.append_audit(scans(spark, 4))
    rollup.roll_up(store, dt.date(2026, 1, 28))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        plan = rollup.daily_activity(rollup.daily(store), at("2026-01-29 00:00:00"), 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    log = next(line for line in plan.split("FileScan") if "/audit]" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*NOT day#\d+ IN", log) and re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2026-01-22", log), log
