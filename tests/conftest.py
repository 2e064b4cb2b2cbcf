from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagetide.plans.derived import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagetide-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    prepare(session)
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Value of a column expression built from literals."""
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
