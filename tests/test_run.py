"""Whole runs on a store: what is due, what is reported, what a crash leaves."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagetide.plans import run as runs
from pagetide.plans.run import RunTotals, run_scan
from pagetide.plans.scan import scan_batch
from pagetide.sources.tables import RunConflict, TableStore

from test_scan import CHANGED, DATES, DAY, NO_DATES, snapshots


class Site:
    """A store, two targets, and the reports that went out."""

    def __init__(self, spark):
        self.spark, self.runs, self.mails, self.up = spark, 0, [], True
        self.store = TableStore(spark, tempfile.mkdtemp(prefix="pagetide-test-"))
        self.store.create()
        self.urls = {"alpha": "https://alpha.org/", "beta": "https://beta.org/"}

    def deliver(self, report):
        self.mails.append((report.subject, [r.asDict() for r in report.entries.collect()]))
        return self.up

    def __call__(self, day, run=None, **pages):
        kept = {k: pages.pop(k) for k in ("force", "only", "replies") if k in pages}
        self.runs += 1
        targets = self.spark.createDataFrame([(k, u, f"{k.title()} Summit") for k, u in self.urls.items()], "target_id string, primary_url string, name string")
        at = DAY + timedelta(days=day)
        shots = snapshots(self.spark, day, **pages).withColumn("fetch_duration_ms", F.lit(1500).cast("bigint"))
        return run_scan(self.store, targets, shots, F.array(F.lit("conference")), run or f"run-{self.runs}", F.lit(at.isoformat()).cast("timestamp"), deliver=self.deliver, **kept)

    @property
    def state(self):
        return {r["target_id"]: r for r in self.store.state().collect()}

    def seen(self):
        return sorted(map(str, self.store.state().collect())), sorted(map(str, self.store.audit().collect())), self.store.history().count()


@pytest.fixture
def site(spark):
    return Site(spark)


def test_a_life_in_runs(site):
    told = site(0, alpha=NO_DATES, beta=DATES)
    assert (told.scanned, told.succeeded, told.failed, told.sent) == (2, 2, 0, True)
    assert told.subject.startswith("🚨") and told.subject.endswith("1 deadlines published, 1 no change")
    assert [(e["name"], e["section"]) for e in site.mails[0][1]] == [("Beta Summit", "CHANGE_WITH_DATES"), ("Alpha Summit", "NO_CHANGE")]
    state = site.state
    assert (state["alpha"]["watch_mode"], state["beta"]["watch_mode"]) == ("MONTHLY", "URGENT")
    assert state["beta"]["current_summary"].startswith("Found 1 deadline(s). - paper: 2026-04-02") and state["alpha"]["current_summary"] is None
    audit = {r["target_id"]: r for r in site.store.audit().collect()}
    assert all(r["email_sent"] and r["scan_duration_seconds"] == 1.5 for r in audit.values())
    assert not audit["beta"]["llm_api_called"] and audit["beta"]["summary"] == state["beta"]["current_summary"]

    # nothing due, nothing told; forced, only the named target is scanned, and its failure is told once
    assert site(0.5, alpha=NO_DATES, beta=DATES) == RunTotals(0, 0, 0, None, False) and len(site.mails) == 1
    told = site(0.6, alpha=None, beta=None, force=True, only=["alpha"])
    assert (told.scanned, told.failed) == (1, 1) and site.mails[1][0].endswith("1 error")
    assert site.mails[1][1][0]["error_message"] == "timeout"
    site(0.7, alpha=None, force=True, only=["alpha"])
    assert len(site.mails) == 2 and site.state["alpha"]["error_streak"] == 2

    # a change with a reply; the report does not go out
    site.up = False
    replies = site.spark.createDataFrame([("alpha", DAY + timedelta(days=3), "Moved to the hall.")], "target_id string, scan_ts timestamp, summary string")
    told = site(3, alpha=CHANGED, force=True, replies=replies)
    assert told.subject.endswith("1 updated") and not told.sent
    row = site.store.audit().filter(F.col("scan_ts") == F.lit((DAY + timedelta(days=3)).isoformat()).cast("timestamp")).first()
    assert (row["summary"], row["llm_api_called"], row["email_sent"], row["new_watch_mode"]) == ("Moved to the hall.", True, False, "BIWEEKLY")
    assert site.state["alpha"]["current_summary"] == "Moved to the hall." and site.state["alpha"]["error_streak"] == 0


def test_pages_are_picked_once_for_all_steps(site, monkeypatch):
    """Hashes, running values and texts read the chosen pages; once each of them joined and shuffled the html anew."""
    plans = []
    monkeypatch.setattr(runs, "scan_batch", lambda shots, *a: plans.append(runs.on_time.given) or scan_batch(shots, *a))
    real = runs.on_time
    def on_time(shots, state):
        on_time.given = shots._jdf.queryExecution().executedPlan().toString()
        return real(shots, state)
    monkeypatch.setattr(runs, "on_time", on_time)
    site(0, alpha=NO_DATES, beta=DATES)
    assert "Exchange" not in plans[0] and "Join" not in plans[0]


def test_targets_come_go_and_move(site):
    site(0, alpha=NO_DATES, beta=NO_DATES)
    site.urls = {"alpha": "https://alpha.org/new"}
    told = site(1, alpha=NO_DATES, beta=NO_DATES, force=True)
    state = site.state
    assert told.scanned == 1 and not state["beta"]["is_active"] and state["alpha"]["total_scans"] == 2
    assert site.store.audit().filter("target_id = 'alpha'").count() == 2 and state["alpha"]["no_change_streak"] == 0  # a new baseline


def test_a_run_is_seen_whole_or_not_at_all(site, monkeypatch):
    site(0, run="one", alpha=NO_DATES, beta=NO_DATES)
    before = site.seen()
    by_day = TableStore._by_day

    def broken(self, rows, name):
        if name == "history":
            raise OSError("executor lost")
        return by_day(self, rows, name)

    monkeypatch.setattr(TableStore, "_by_day", broken)
    with pytest.raises(OSError):
        site(1, run="two", alpha=CHANGED, beta=DATES, force=True)
    monkeypatch.undo()
    assert site.seen() == before and not site.store.has_batch("two")
    first = site(1, run="two", alpha=CHANGED, beta=DATES, force=True)
    after = site.seen()
    assert (first.scanned, len(after[1]), after[2]) == (2, 4, 4)
    # again under the same name: nothing is done, the same totals are given
    assert site(9, run="two", alpha=DATES, beta=DATES, force=True) == first and site.seen() == after
    # what the broken run has left is swept away
    site.store.retire(keep=1)
    assert site.seen() == after


def test_two_runs_from_one_state(site):
    site(0, alpha=NO_DATES)
    store, none = site.store, site.store.audit().drop("day").limit(0)
    base, state = store.version(), store.state()
    store.write_run("a", base, state, none, store.history().drop("day").limit(0))
    before = site.seen()
    with pytest.raises(RunConflict):
        store.write_run("b", base, state.limit(0), none, store.history().drop("day").limit(0))
    assert site.seen() == before
    with pytest.raises(ValueError):
        store.write_run("a/b", base, state, none, none)


def test_logs_of_runs_are_pruned_by_day(site):
    site(0, alpha=NO_DATES)
    plan = site.store.audit().filter("day = DATE'2026-02-01'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and plan.count("(day#") >= 2
    assert site.store.audit().filter("day = DATE'2026-02-01'").count() == 1
