"""Watch modes: ranks, intervals, one-step transitions, notification class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modes in rising rank and the days between two scans.
MODES = ("MONTHLY", "BIWEEKLY", "URGENT")
INTERVAL_DAYS = {"MONTHLY": 30, "BIWEEKLY": 14, "URGENT": 1}


def mode_rank(mode: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODES]), mode).cast("int") - 1


def mode_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODES]), (rank + 1).cast("int"))


def outcome_rank(changed: Column, n_deadlines: Column) -> Column:
    """Lowest mode a scan outcome leads to; a mode never falls below it."""
    return F.when(changed & (n_deadlines > 0), 2).when(changed, 1).otherwise(0)


def next_mode(mode: Column, changed: Column, n_deadlines: Column) -> Column:
    return (
        F.when(mode == "URGENT", F.lit("URGENT"))
        .when(~changed, mode)
        .when(n_deadlines > 0, F.lit("URGENT"))
        .otherwise(F.lit("BIWEEKLY"))
    )


def transition_reason(mode: Column, changed: Column, n_deadlines: Column) -> Column:
    return (
        F.when(mode == "URGENT", F.lit("ALREADY_URGENT"))
        .when(~changed, F.lit("NO_CHANGE"))
        .when(n_deadlines > 0, F.lit("DEADLINES_PUBLISHED"))
        .when(mode == "MONTHLY", F.lit("CONTENT_UPDATED_NO_DATES"))
        .otherwise(F.lit("CONTINUE_MONITORING"))
    )


def interval_days(mode: Column) -> Column:
    pairs = [F.lit(x) for kv in INTERVAL_DAYS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), mode)


def next_run(mode: Column, base: Column, hour: int = 0, minute: int = 0) -> Column:
    """The given time of day, one interval after `base`."""
    day = F.date_add(F.to_date(base), interval_days(mode))
    return day.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))


def overdue(next_run_at: Column, as_of: Column) -> Column:
    return as_of >= next_run_at


def seconds_until(next_run_at: Column, as_of: Column) -> Column:
    """Time left in seconds, negative once the run is overdue."""
    return F.unix_micros(next_run_at) / 1e6 - F.unix_micros(as_of) / 1e6


def notification_class(changed: Column, n_deadlines: Column) -> Column:
    return (
        F.when(~changed, F.lit("NO_CHANGE"))
        .when(n_deadlines > 0, F.lit("CHANGE_WITH_DATES"))
        .otherwise(F.lit("CHANGE_NO_DATES"))
    )


def alert_due(error_streak: Column, every: int = 7) -> Column:
    return (error_streak == 1) | ((error_streak > 0) & (error_streak % every == 0))


def transition_summary(old: Column, new: Column, reason: Column, changed: Column, change_type: Column, deadlines: Column) -> Column:
    """Several lines of text, one per deadline at the end."""
    lines = F.transform(deadlines, lambda d: F.concat(F.lit("  - "), d["date"].cast("string"), F.lit(" ("), d["type"], F.lit(")")))
    head = F.array(
        F.concat(F.lit("Transition: "), old, F.lit(" → "), new),
        F.concat(F.lit("Reason: "), reason),
        F.concat(F.lit("Change detected: "), F.when(changed, F.lit("True")).otherwise(F.lit("False")), F.lit(" ("), change_type, F.lit(")")),
        F.concat(F.lit("Deadlines found: "), F.size(deadlines).cast("string")),
    )
    tail = F.when(F.size(deadlines) > 0, F.concat(F.array(F.lit("Deadline dates:")), lines)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, tail), "\n")
