"""Computing a value one time although several expressions use it.

Catalyst puts the definition of a column in the place of its name wherever a
filter or a projection refers to it.  For a chain of pattern matches that can
multiply the work many times over, so two small tools keep a value whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """`rows` with named columns added that later steps only read.

    The columns come out of a one-row generator, through which the optimizer
    neither pushes filters nor inlines definitions.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns))))
