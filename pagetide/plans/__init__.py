"""Whole queries: the scan, the monitoring reports, views derived from the test tables."""
