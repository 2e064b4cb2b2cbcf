"""Monitoring reports from a daily table of partial aggregates.

One row per day, target, change type and fetch method holds counts, sums and
extremes that add up, so a report over a month of a large audit log reads
some rows per target and day instead of every scan.  Sums are exact decimals, hence
each report equals the one of the same name in `plans.monitor`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.plans import monitor as R
from pagetide.sources.tables import TableStore

TABLE = "audit_by_day"
PARTS = ("day", "target_id", "change_type", "fetch_method")
_SUMS = ("scans", "changes", "with_deadlines", "sent", "unsent", "llm_calls", "succeeded", "durations", "duration_sum", "distances", "distance_sum")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(18,6)")


def partials(audit: DataFrame) -> DataFrame:
    """The partial aggregates of audit rows as `monitor.reported_audit` gives them."""
    day = F.col("day") if "day" in audit.columns else F.to_date("scan_ts")
    return audit.groupBy(day.alias("day"), "target_id", "change_type", "fetch_method").agg(
        F.count(F.lit(1)).alias("scans"), F.count_if("change_detected").alias("changes"),
        F.count_if(F.col("deadlines_count") > 0).alias("with_deadlines"), F.count_if("email_sent").alias("sent"),
        F.count_if(~F.col("email_sent")).alias("unsent"), F.count_if("llm_api_called").alias("llm_calls"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count("scan_duration_seconds").alias("durations"), F.sum(_exact("scan_duration_seconds")).alias("duration_sum"),
        F.count("hamming_distance").alias("distances"), F.sum(_exact("hamming_distance")).alias("distance_sum"),
        F.min("scan_duration_seconds").alias("duration_min"), F.max("scan_duration_seconds").alias("duration_max"),
        F.max("scan_ts").alias("last_scan"),
    )


def roll_up(store: TableStore, before: dt.date, again_from: dt.date | None = None) -> list[dt.date]:
    """Write the partial aggregates of the audit days before `before` that have none yet; returns the days that are held now.

    `again_from` also redoes the days from there on, for a backfill that has added rows to days already held.  A day
    appears by one rename; a run that dies leaves whole days, and the rest is read from the log until the next call.
    """
    held = [d for d in store.days(TABLE) if again_from is None or d < again_from]
    rows = R.reported_audit(store.audit()).filter((F.col("day") < F.lit(before)) & ~F.col("day").isin(held))
    out = partials(rows).hint("rebalance", F.col("day"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{store.root}/{TABLE}")
    return store.days(TABLE)


def daily(store: TableStore) -> DataFrame:
    """Partial aggregates of all days: the held ones from their table, the others from the log."""
    held = store.days(TABLE)
    log = R.reported_audit(store.audit())
    if not held:
        return partials(log)
    rest = partials(log.filter(F.col("day").isNull() | ~F.col("day").isin(held)))
    kept = store.spark.read.schema(rest.schema).parquet(f"{store.root}/{TABLE}").filter(F.col("day").isin(held))
    return rest.unionByName(kept)


def _since(rolled: DataFrame, as_of: Column, days: int) -> DataFrame:
    return rolled.filter(F.col("day") >= F.date_sub(F.to_date(as_of), days))


def _total(name: str) -> Column:
    if name not in _SUMS:
        raise ValueError(f"no sum: {name!r}")
    return F.coalesce(F.sum(name), F.lit(0))


def _mean(total: str, number: str, digits: int) -> Column:
    """As `monitor.exact_avg`: null without a value, ten digits before rounding."""
    share = F.try_divide(F.sum(total).cast("decimal(26,6)"), F.sum(number).cast("decimal(14,0)"))
    return F.round(share.cast("decimal(22,10)"), digits).cast("double")


def _duration(digits: int) -> Column:
    return _mean("duration_sum", "durations", digits)


def _percent(name: str, digits: int | None = None, of: str = "scans") -> Column:
    share = F.try_divide(F.lit(100.0) * _total(name), _total(of))
    return share if digits is None else F.round(share, digits)


def daily_activity(rolled: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return _since(rolled, as_of, days).groupBy(F.col("day").alias("scan_date")).agg(
        _total("scans").alias("total_scans"), _total("changes").alias("changes_detected"), _total("with_deadlines").alias("deadlines_found"),
        _total("sent").alias("emails_sent"), _total("llm_calls").alias("llm_calls"), _duration(2).alias("avg_duration_sec"),
    ).orderBy(F.desc("scan_date"))


def target_summary(rolled: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return _since(rolled, as_of, days).groupBy("target_id").agg(
        _total("scans").alias("total_scans"), _total("changes").alias("changes_detected"), _total("with_deadlines").alias("scans_with_deadlines"),
        F.max("last_scan").alias("last_scan"), _duration(2).alias("avg_duration_sec"),
    ).orderBy("target_id")


def change_breakdown(rolled: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return _since(rolled, as_of, days).groupBy("change_type").agg(
        _total("scans").alias("scans"), _mean("distance_sum", "distances", 1).alias("avg_hamming_distance")
    ).orderBy(F.desc("scans"))


def llm_usage(rolled: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return _since(rolled, as_of, days).agg(
        _total("scans").alias("total_scans"), _total("llm_calls").alias("llm_calls"), _percent("llm_calls", 1).alias("llm_call_percentage"),
        F.round(_total("llm_calls") * R.USD_PER_CALL, 2).alias("estimated_cost_usd"),
    )


def delivery_rate(rolled: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return _since(rolled, as_of, days).agg(
        _total("scans").alias("total_scans"), _total("sent").alias("emails_sent"), _percent("sent", 1).alias("success_rate"),
        _percent("sent", 1, of="succeeded").alias("success_rate_of_scanned"),
    )


def scan_performance(rolled: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    rendered = F.bool_or(F.coalesce(F.col("fetch_method") == "playwright", F.lit(False)))
    return _since(rolled, as_of, days).groupBy("target_id").agg(
        _total("scans").alias("scan_count"), _duration(2).alias("avg_duration"), F.round(F.min("duration_min"), 2).alias("min_duration"),
        F.round(F.max("duration_max"), 2).alias("max_duration"), F.when(rendered, "Yes").otherwise("No").alias("used_playwright"),
    ).orderBy(F.desc("avg_duration"))


def delivery_alert(rolled: DataFrame, as_of: Column, days: int = 7, tolerated: int = 5) -> DataFrame:
    return _since(rolled, as_of, days).agg(_total("unsent").alias("failure_count")).filter(F.col("failure_count") > tolerated)


def weekly_summary(rolled: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Over whole days, from midnight `days` days ago."""
    return _since(rolled, as_of, days).agg(
        F.countDistinct("day").alias("days_active"), _total("scans").alias("total_scans"), _total("changes").alias("changes_detected"),
        _total("with_deadlines").alias("deadlines_discovered"), _total("sent").alias("emails_sent"), _duration(2).alias("avg_scan_duration"),
    )


def slow_scans(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("target_id").agg(
        _duration(6).alias("avg_duration"), F.max("duration_max").alias("max_duration")
    ).orderBy(F.desc("avg_duration"))


def fetch_methods(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("target_id", "fetch_method").agg(_total("scans").alias("scans"))


def llm_percentage(rolled: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return _since(rolled, as_of, days).agg(
        _total("scans").alias("total_scans"), _total("llm_calls").alias("llm_calls"), _percent("llm_calls").alias("llm_call_percentage")
    )


def health_bands(rolled: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(metric, value, band) of five figures of the last days."""
    figures = _since(rolled, as_of, days).agg(
        _duration(4).alias("scan_duration"), _percent("sent", 4, of="succeeded").alias("email_delivery"),
        F.round(_total("llm_calls") / F.lit(float(days)), 4).alias("llm_calls_per_day"),
        F.round(_total("llm_calls") * R.USD_PER_CALL / F.lit(float(days)), 4).alias("daily_cost"), _percent("succeeded", 4).alias("success_rate"),
    )
    return R.banded(figures)
