"""Running aggregates that survive a key holding a large share of the rows.

A plain window puts all rows of a key in one task.  Here the rows of a key are
cut into time chunks; each chunk is windowed on its own, chunk totals (one row
per key and chunk) are accumulated per key, and both are added up.  The largest
group any task sees is one chunk of one key, or the chunk totals of one key.

Where many rows of a key may share one time (a backfill, a month of calls within
an hour), `sliced_running` cuts by rank instead of by the clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.sources.scratch import cut


@dataclass(frozen=True)
class Running:
    """A running `kind` (sum, max or last) of `value`; `last` skips NULLs.

    With `inclusive=False` the current row does not count.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def time_chunk(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds).cast("bigint")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, measures: Sequence[Running]) -> DataFrame:
    """Adds one column per measure.  `chunk` must not fall along `order`."""
    chunked = rows.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    first = Window.unboundedPreceding
    local = chunked
    totals, carried = [], []
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(first, -1)
    for i, m in enumerate(measures):
        frame = inside.rowsBetween(first, 0 if m.inclusive else -1)
        if m.kind == "sum":
            part, total, carry = F.sum(m.value), F.sum(m.value), F.sum(f"_t{i}")
        elif m.kind == "max":
            part, total, carry = F.max(m.value), F.max(m.value), F.max(f"_t{i}")
        elif m.kind == "last":
            part = F.last(m.value, ignorenulls=True)
            total = F.max_by(m.value, F.when(m.value.isNotNull(), F.struct(*order)))
            carry = F.last(f"_t{i}", ignorenulls=True)
        else:
            raise ValueError(f"unknown running aggregate {m.kind!r}")
        local = local.withColumn(f"_p{i}", part.over(frame))
        totals.append(total.alias(f"_t{i}"))
        carried.append(carry.over(earlier).alias(f"_c{i}"))
    prefix = chunked.groupBy(*keys, "_chunk").agg(*totals).select(*keys, "_chunk", *carried)
    joined = local.join(prefix, [*keys, "_chunk"])
    out = []
    for i, m in enumerate(measures):
        part, carry = F.col(f"_p{i}"), F.col(f"_c{i}")
        if m.kind == "sum":
            value = F.coalesce(part, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif m.kind == "max":
            value = F.greatest(part, carry)
        else:
            value = F.coalesce(part, carry)
        out.append(value.alias(m.name))
    return joined.select(*rows.columns, *out)


def slices(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: int | None = None, out: str = "_slice") -> DataFrame:
    """Adds `out`, the number of the row's slice: about equally many rows each, rising along (keys, order).

    The rows are partitioned by range on keys and order, so a slice holds many
    small keys or a part of a large one, whatever the times are.  Only rows
    equal in all of keys and order cannot be told apart and share a slice.
    Without `number` there are `spark.sql.shuffle.partitions` slices, fewer
    where adaptive execution joins small neighbours.  The sampled bounds of the
    ranges must not be drawn anew by a retry, hence the checkpoint.
    """
    by = [F.col(c) for c in [*keys, *order]]
    ranged = rows.repartitionByRange(*by) if number is None else rows.repartitionByRange(number, *by)
    return cut(ranged.withColumn(out, F.spark_partition_id()))


def sliced_running(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[Running],
    along: Sequence[str] | None = None, number: int | None = None,
) -> DataFrame:
    """`running` over slices: no task holds more than one slice, and a key has one total per slice.

    `along` is the part of `order` that slices are cut by, from its start; all of it where not given.
    """
    cols = rows.columns
    parted = slices(rows, keys, order if along is None else along, number)
    return running(parted, keys, order, F.col("_slice"), measures).select(*cols, *[m.name for m in measures])
