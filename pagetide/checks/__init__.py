"""Named queries and the SQL each one is checked against."""

from pagetide.checks import change_checks, deadline_checks, link_checks, monitor_checks, report_checks, request_checks, stream_checks, table_checks, text_checks, watch_checks  # noqa: F401
from pagetide.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
