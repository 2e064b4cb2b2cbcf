from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, score double, component string, uid long, word string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns that clash with names the operators use inside."""

    def make(rows, schema=None):
        if schema is not None:
            return spark.createDataFrame(rows, schema)
        return spark.createDataFrame([(i, t, None, 0.5, "x", 1, "w") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))


PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards mix a potion of rare herbs and the old clock "
         "strikes twelve times before anyone in the quiet village wakes up to find the river frozen and the mill silent")


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, blanks, one word, a very long text, repeated rows, a null id."""
    long = " ".join(f"word{i % 5003}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, PROSE), (5, PROSE), (6, PROSE), (7, long), (8, "x" * 50_000), (None, PROSE), (9, "Zürich élan 東京 🚀 naïve")]
