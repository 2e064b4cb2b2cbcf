"""The registered queries: names, plans, and a few that hold for any data."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from pagetide.checks import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_survey_line_has_a_query():
    wanted = {"a": 16, "b": 9, "c": 12, "d": 8, "e": 11, "f": 20, "g": 5, "h": 25, "i": 8, "j": 4}
    have = {re.match(r"([a-j]\d+)_", name).group(1) for name in QUERIES}
    assert {f"{s}{i}" for s, n in wanted.items() for i in range(1, n + 1)} == have


def test_all_queries_have_checking_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["change_type"] for r in rows} == {"NONE", "FILTERED", "BINARY"}


def plan(spark, name, optimized=False):
    execution = entry.queries()[name](spark, SF)._jdf.queryExecution()
    return (execution.optimizedPlan() if optimized else execution.executedPlan()).toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] in "bcdefgi" and not n.startswith("c8")))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "h23_latest_failures")
    assert "TakeOrderedAndProject" in text
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert "props" not in schema
    assert re.search(r"PushedFilters: \[[^\]]*event_type", text) or "event_type" in schema


def test_top_links_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "e10_top_links")


def test_library_stands_without_the_training_data_operators(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n == 'pipeline' or n.startswith('op')]; assert len(e.oracle_sql()) == len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)
