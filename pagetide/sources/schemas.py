"""Table schemas and the text form of the nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEADLINES = T.ArrayType(
    T.StructType([
        T.StructField("date", T.DateType()),
        T.StructField("type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source_text", T.StringType()),
    ])
)
LINKS = T.ArrayType(
    T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("first_seen", T.TimestampType()),
    ])
)

SNAPSHOTS = T.StructType([
    T.StructField("target_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("fetch_method", T.StringType()),
    T.StructField("scan_ts", T.TimestampType()),
    T.StructField("fetch_duration_ms", T.LongType()),
])

STATE = T.StructType([
    T.StructField("target_id", T.StringType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("watch_mode", T.StringType()),
    T.StructField("next_run_at", T.TimestampType()),
    T.StructField("last_scan_at", T.TimestampType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("binary_hash", T.StringType()),
    T.StructField("filtered_hash", T.StringType()),
    T.StructField("simhash", T.LongType()),
    T.StructField("current_deadlines", DEADLINES),
    T.StructField("current_summary", T.StringType()),
    T.StructField("tracked_links", LINKS),
    T.StructField("no_change_streak", T.LongType()),
    T.StructField("error_streak", T.LongType()),
    T.StructField("total_scans", T.LongType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

AUDIT = T.StructType([
    T.StructField("audit_id", T.StringType(), False),
    T.StructField("target_id", T.StringType()),
    T.StructField("scan_ts", T.TimestampType()),
    T.StructField("change_detected", T.BooleanType()),
    T.StructField("change_type", T.StringType()),
    T.StructField("hamming_distance", T.IntegerType()),
    T.StructField("deadlines_found", DEADLINES),
    T.StructField("summary", T.StringType()),
    T.StructField("previous_watch_mode", T.StringType()),
    T.StructField("new_watch_mode", T.StringType()),
    T.StructField("transition_reason", T.StringType()),
    T.StructField("fetch_method", T.StringType()),
    T.StructField("scan_duration_seconds", T.DoubleType()),
    T.StructField("llm_api_called", T.BooleanType()),
    T.StructField("email_sent", T.BooleanType()),
])

HISTORY = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("target_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("fetch_method", T.StringType()),
    T.StructField("fetch_duration_ms", T.LongType()),
    T.StructField("change_detected", T.BooleanType()),
    T.StructField("deadlines_count", T.IntegerType()),
    T.StructField("email_type", T.StringType()),
    T.StructField("error_details", T.StringType()),
])

TABLES = {"state": STATE, "audit": AUDIT, "history": HISTORY}
KEYS = {"state": ["target_id"], "audit": ["audit_id"], "history": ["run_id"]}


def schema_of(name: str) -> T.StructType:
    try:
        return TABLES[name]
    except KeyError:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}") from None


def empty_list(schema: T.ArrayType) -> Column:
    return F.array().cast(schema)


def list_to_json(col: Column, schema: T.ArrayType) -> Column:
    """JSON text of a nested list; NULL and empty lists are '[]'."""
    return F.to_json(F.coalesce(col, empty_list(schema)))


def list_from_json(text: Column, schema: T.ArrayType) -> Column:
    """Inverse of `list_to_json`; NULL and '' are the empty list."""
    return F.coalesce(F.from_json(F.when(text != "", text), schema), empty_list(schema))
