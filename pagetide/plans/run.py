"""A whole run: reconcile, choose what is due, scan, summarise, report, write as one transaction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators import report as R
from pagetide.operators import watch as W
from pagetide.operators.requests import fallback_summary
from pagetide.plans.scan import SNAPSHOT, late_audit, on_time, scan_batch, scan_tables
from pagetide.sources.scratch import cut
from pagetide.sources.tables import TableStore, upsert


@dataclass(frozen=True)
class Report:
    """What a run has to tell: its subject line, and its entries as they are shown."""

    run: str
    subject: str
    entries: DataFrame


@dataclass(frozen=True)
class RunTotals:
    scanned: int
    succeeded: int
    failed: int
    subject: str | None
    sent: bool


def summarised(results: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Adds summary and llm_api_called: a changed scan's reply (target_id, scan_ts, summary), or a summary made from what was found."""
    if replies is None:
        replies = results.sparkSession.createDataFrame([], "target_id string, scan_ts timestamp, summary string")
    told = replies.groupBy(*SNAPSHOT).agg(F.max("summary").alias("_reply"))
    changed = (F.col("status") == "succeeded") & F.col("change_detected")
    own = fallback_summary(F.col("deadlines_found"), F.coalesce("snippets", F.array().cast("array<string>")))
    joined = results.join(told, SNAPSHOT, "left")
    return joined.withColumns({
        "summary": F.when(changed, F.coalesce("_reply", own)), "llm_api_called": changed & F.col("_reply").isNotNull(),
    }).drop("_reply")


def run_entries(results: DataFrame, state: DataFrame, names: DataFrame) -> DataFrame:
    """Report entries of a run's scans: the successful ones, and the failures that are due an alert.

    `state` is the state after the run, `names` has target_id and name; a target without a name goes by its id.
    """
    known = results.join(names.select("target_id", "name").dropDuplicates(["target_id"]), "target_id", "left").withColumn("name", F.coalesce("name", "target_id"))
    known = known.join(state.select("target_id", "current_deadlines"), "target_id", "left")
    good = R.report_entries(known.filter("status = 'succeeded'"))
    bad = R.error_entries(known.filter("status = 'failed'").withColumn("error_message", F.col("error")))
    return R.ordered_entries(good.unionByName(bad, allowMissingColumns=True))


def run_scan(
    store: TableStore, targets: DataFrame, snapshots: DataFrame, keywords: Column, run: str, as_of: Column, *,
    force: bool = False, only: list[str] | None = None, replies: DataFrame | None = None, deliver: Callable[[Report], bool] | None = None,
) -> RunTotals:
    """One run over the targets that are due at `as_of`; `force` takes all active ones, `only` just those named.

    `targets` has target_id, primary_url and maybe name; `snapshots` the pages fetched for them (see `scan_batch`), of which those of targets that
    are not due are left alone.  `replies` holds summaries of changed scans.  `deliver` gets the report and says
    whether it went out; it is called where there is something to tell, before the run is written, so a run that
    dies in between reports again.  A run of a name that is finished is not done again; its totals are given.

    State, audit and history of the run become visible together.
    """
    done = store.note(run)
    if done is not None:
        return RunTotals(**done)
    base = store.version()
    state = cut(W.reconcile(store.state(), targets, as_of).drop("action"))
    due = W.due_targets(state, as_of, force)
    if only is not None:
        due = due.filter(F.col("target_id").isin(only))
    # Written once: hashes, their running values and texts would each shuffle the html anew.
    pages = cut(snapshots.join(due.select("target_id"), "target_id", "left_semi").dropDuplicates(SNAPSHOT))
    results = cut(summarised(scan_batch(on_time(pages, state), state, keywords, F.lit(run)), replies))
    new_state = cut(upsert(state, scan_tables(results, state).state, ["target_id"]))
    totals = W.run_totals(results).first()
    names = targets if "name" in targets.columns else targets.withColumn("name", F.col("target_id"))
    entries = run_entries(results, new_state, names)
    subject = R.report_subjects(entries).first()
    sent = bool(subject and deliver and deliver(Report(run, subject["subject"], entries)))
    deliveries = results.sparkSession.createDataFrame([(run, sent)], "run_id string, sent boolean")
    written = scan_tables(R.mark_reported(results.withColumn("email_sent", F.lit(False)), deliveries), state)
    told = RunTotals(totals["scanned"], totals["succeeded"], totals["failed"], subject["subject"] if subject else None, sent)
    store.write_run(run, base, new_state, written.audit.unionByName(late_audit(pages, state, F.lit(run))), written.history, asdict(told))
    return told
