"""Whole scans over a few targets, batch and streamed."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagetide.operators import text as T
from pagetide.operators import watch as W
from pagetide.plans.scan import scan_batch, scan_tables
from pagetide.sources import schemas
from pagetide.sources.tables import TableStore, upsert
from pagetide.streaming import incremental as I

DAY = datetime(2026, 2, 1, 6)
NO_DATES = "<html><body><nav>m</nav><main><p>The conference will take place in the old town.</p></main></body></html>"
CHANGED = NO_DATES.replace("old town", "new town hall")
NAV_ONLY = NO_DATES.replace("<nav>m", "<nav>other")
DATES = "<html><body><main><p>Paper submission deadline: April 2, 2026.</p></main></body></html>"


def snapshots(spark, day, **pages):
    rows = [(t, f"https://{t}.org/", None if h is None else h, "requests", DAY + timedelta(days=day), "timeout" if h is None else None) for t, h in pages.items()]
    return spark.createDataFrame(rows, "target_id string, url string, html string, fetch_method string, scan_ts timestamp, error string")


class Run:
    def __init__(self, spark):
        self.spark, self.state = spark, spark.createDataFrame([], schemas.STATE)

    def __call__(self, day, **pages):
        results = scan_batch(snapshots(self.spark, day, **pages), self.state, F.array(F.lit("deadline")), F.lit(f"run-{day}"))
        tables = scan_tables(results, self.state)
        new = upsert(self.state, tables.state, ["target_id"])
        self.state = self.spark.createDataFrame(new.collect(), schemas.STATE)
        self.audit = {r["target_id"]: r for r in tables.audit.collect()}
        self.history = {r["target_id"]: r for r in tables.history.collect()}
        return {r["target_id"]: r for r in self.state.collect()}


@pytest.fixture
def run(spark):
    return Run(spark)


def test_life_of_two_targets(run):
    state = run(0, alpha=NO_DATES, beta=DATES)
    assert (state["alpha"]["watch_mode"], state["alpha"]["next_run_at"]) == ("MONTHLY", datetime(2026, 3, 3))
    assert run.audit["alpha"]["change_type"] == "NONE" and not run.audit["alpha"]["change_detected"]
    assert state["beta"]["watch_mode"] == "URGENT" and run.audit["beta"]["change_type"] == "BINARY"
    assert [(str(d["date"]), d["type"]) for d in state["beta"]["current_deadlines"]] == [("2026-04-02", "paper")]
    assert run.history["beta"]["email_type"] == "CHANGE_WITH_DATES" and run.history["alpha"]["email_type"] == "NO_CHANGE"

    state = run(1, alpha=NAV_ONLY, beta=DATES)
    assert run.audit["alpha"]["hamming_distance"] == 0 and state["alpha"]["watch_mode"] == "MONTHLY"
    assert (state["alpha"]["no_change_streak"], state["beta"]["no_change_streak"]) == (1, 1)
    assert run.audit["beta"]["transition_reason"] == "ALREADY_URGENT"
    assert len(state["beta"]["current_deadlines"]) == 1 and run.audit["beta"]["deadlines_found"] == []

    state = run(2, alpha=None, beta=DATES)
    assert (state["alpha"]["error_streak"], state["alpha"]["last_error"], state["alpha"]["no_change_streak"]) == (1, "timeout", 1)
    assert state["alpha"]["next_run_at"] == datetime(2026, 3, 4)
    assert run.audit["alpha"]["transition_reason"] == "SCAN_FAILED: timeout" and run.history["alpha"]["status"] == "failed"
    assert state["alpha"]["total_scans"] == 2 and state["alpha"]["last_scan_at"] == DAY + timedelta(days=1)

    state = run(3, alpha=CHANGED)
    assert (state["alpha"]["watch_mode"], run.audit["alpha"]["change_type"]) == ("BIWEEKLY", "FILTERED")
    assert state["alpha"]["error_streak"] == state["alpha"]["no_change_streak"] == 0 and state["alpha"]["last_error"] is None
    assert state["beta"]["total_scans"] == 3

    state = run(4, alpha=DATES)
    assert (state["alpha"]["watch_mode"], run.audit["alpha"]["transition_reason"]) == ("URGENT", "DEADLINES_PUBLISHED")
    assert state["alpha"]["next_run_at"] == datetime(2026, 2, 6)


LIST = "<ul><li>Abstract deadline: March 15, 2026</li><li>Paper deadline: April 30, 2026<li>Registration deadline: May 15, 2026</ul>"


@pytest.mark.parametrize("page", [
    f"<html><body><main><h2>Dates</h2>{LIST}</main></body></html>",
    f"<html><body><div class='sidebar'>x</div><nav><nav>m</nav></nav><main><h2>Dates</h2>{LIST}</main></body></html>",
])
def test_a_list_of_dates_gives_all_of_them(run, page):
    found = run(0, alpha=page)["alpha"]["current_deadlines"]
    assert [(str(d["date"]), d["type"]) for d in found] == [("2026-03-15", "abstract"), ("2026-04-30", "paper"), ("2026-05-15", "registration")]


def test_line_ends_change_no_fingerprint(spark):
    page = "<body><main><p>One<br>two</p><pre>a  b</pre><div>c</div></main></body>"
    texts = T.page_texts(spark.createDataFrame([(1, page)], "page_id int, html string"), F.array(F.lit("one"))).first()
    plain = T.filtered_text(spark.createDataFrame([(1, page)], "page_id int, html string")).first()["filtered_text"]
    assert texts["filtered_text"] == plain and texts["main_text"].split("\n") == ["One", "two", "a b", "c"]


def test_missing_page_is_an_empty_page(run):
    run(0, alpha=NO_DATES)
    assert run(1, alpha="")["alpha"]["watch_mode"] == "BIWEEKLY"


def test_reconcile(spark):
    def target(name, url=None):
        return (name, url or f"https://{name}.org/")
    state = spark.createDataFrame([], schemas.STATE)
    shape = "target_id string, primary_url string"
    now = F.lit("2026-02-01 00:00:00").cast("timestamp")

    def reconciled(state, *targets):
        out = W.reconcile(state, spark.createDataFrame(list(targets), shape), now)
        rows = out.collect()
        return spark.createDataFrame([r[:-1] for r in rows], schemas.STATE), {r["target_id"]: r for r in rows}

    state, rows = reconciled(state, target("a"), target("b"))
    assert {k: (r["action"], r["watch_mode"], r["is_active"]) for k, r in rows.items()} == {k: ("inserted", "MONTHLY", True) for k in "ab"}
    state, rows = reconciled(state, target("a"), target("b"))
    assert {r["action"] for r in rows.values()} == {""}
    state, rows = reconciled(state.withColumn("binary_hash", F.lit("x")), target("a", "HTTPS://A.org"), target("c"))
    assert {k: r["action"] for k, r in rows.items()} == {"a": "", "b": "deactivated", "c": "inserted"}
    assert rows["a"]["binary_hash"] == "x" and not rows["b"]["is_active"]
    state, rows = reconciled(state, target("a", "https://a.org/new"), target("b"), target("c"))
    assert {k: r["action"] for k, r in rows.items()} == {"a": "url_changed", "b": "reactivated", "c": ""}
    assert rows["a"]["binary_hash"] is None and rows["a"]["url"] == "https://a.org/new"


def test_repeated_batch_changes_nothing(spark):
    root = tempfile.mkdtemp(prefix="pagetide-test-")
    store = TableStore(spark, root)
    store.create()
    scan = I.scan_into(store, F.array(F.lit("deadline")))
    first = snapshots(spark, 0, alpha=NO_DATES, beta=NO_DATES).drop("error")
    second = snapshots(spark, 1, alpha=CHANGED, beta=NO_DATES).unionByName(snapshots(spark, 2, alpha=DATES)).drop("error")
    scan(first, 0)
    scan(second, 1)
    before = sorted(map(tuple, store.state().collect())), store.audit().count(), store.history().count()
    scan(second, 1)
    assert (sorted(map(tuple, store.state().collect())), store.audit().count(), store.history().count()) == before
    state = {r["target_id"]: r for r in store.state().collect()}
    assert (state["alpha"]["watch_mode"], state["alpha"]["total_scans"], state["beta"]["no_change_streak"]) == ("URGENT", 3, 1)
    assert before[1:] == (5, 5)


def test_streams_and_other_runs_share_a_store(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="pagetide-test-"))
    store.create()
    keywords = F.array(F.lit("deadline"))
    results = scan_batch(snapshots(spark, 0, alpha=NO_DATES), store.state(), keywords, F.lit("own"))
    new = scan_tables(results, store.state())
    store.append_once(new.audit, "audit")
    store.write_state(upsert(store.state(), new.state, ["target_id"]))
    I.scan_into(store, keywords, "one")(snapshots(spark, 1, alpha=CHANGED).drop("error"), 0)
    assert store.state().first()["total_scans"] == 2
    # a fresh checkpoint over the old store starts from batch 0 again
    I.scan_into(store, keywords, "two")(snapshots(spark, 2, alpha=CHANGED).drop("error"), 0)
    assert store.state().first()["total_scans"] == 3
    before = store.state().first()
    # a late page and a redelivered one change nothing; the late one is on record
    late = snapshots(spark, 1, alpha=DATES).withColumn("scan_ts", F.col("scan_ts") - F.expr("INTERVAL 1 HOUR"))
    I.scan_into(store, keywords, "two")(late.unionByName(snapshots(spark, 2, alpha=DATES)).drop("error"), 1)
    assert store.state().first() == before
    assert store.audit().filter("transition_reason = 'LATE'").count() == 1 and store.audit().count() == 4


def test_late_rows_are_dropped(spark):
    root = tempfile.mkdtemp(prefix="pagetide-test-")
    shape = "scan_ts timestamp, status string, change_detected boolean, email_sent boolean, llm_api_called boolean"

    def land(name, *days):
        rows = [(datetime(2026, 1, d, 12), "succeeded", True, True, False) for d in days]
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{root}/in/{name}")

    def go():
        log = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        I.append_to(I.daily_activity(log), f"{root}/out", f"{root}/cp").awaitTermination()

    land("one", 1, 1, 2, 6)
    go()
    land("two", 2, 5, 9)
    go()
    got = {r["day"].day: r["total_scans"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {1: 2, 2: 1, 5: 1, 6: 1}
