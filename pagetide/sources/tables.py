"""State, audit and history tables on plain parquet.

The state table is rewritten as a whole on every run: a new snapshot folder is
written and becomes current once Spark has put its _SUCCESS file there, so a
reader never sees half a table and a failed run leaves the old one in place.
Audit and history only grow; both are partitioned by day.

A run writes to all three as one transaction.  It takes a number by creating
`runs/<number>.started`, writes folders of that number, and one rename to
`runs/<number>.<run>` makes them visible together.  Readers leave out the numbers
that were started and not finished, so a run that dies between two tables never shows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from pagetide.sources import schemas


# ---- keyed changes of a table, as plans -----------------------------------

def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`current` with the rows of `incoming` put in place of, or next to, its own.

    `incoming` must hold each key once.  Columns that `incoming` lacks keep
    their old value (NULL for a new key).
    """
    marked = incoming.withColumn("_hit", F.lit(True))
    joined = current.alias("c").join(marked.alias("n"), list(keys), "full_outer")
    columns = []
    for name in current.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in incoming.columns:
            columns.append(F.when(F.col("_hit"), F.col(f"n.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
        else:
            columns.append(F.col(f"c.{name}"))
    return joined.select(*columns)


def partial_update(
    current: DataFrame, updates: DataFrame, keys: Sequence[str], stamp: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new table, keys that matched no row).

    Only columns named in `updates` change; columns the table does not have
    are ignored.  `stamp`, if given, becomes `updated_at` of touched rows.
    """
    known = [c for c in updates.columns if c in current.columns and c not in keys]
    marked = updates.select(*keys, *known).withColumn("_hit", F.lit(True))
    joined = current.alias("c").join(marked.alias("n"), list(keys), "left")
    columns = []
    for name in current.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in known:
            columns.append(F.when(F.col("_hit"), F.col(f"n.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
        elif name == "updated_at" and stamp is not None:
            columns.append(F.when(F.col("_hit"), stamp).otherwise(F.col("c.updated_at")).alias(name))
        else:
            columns.append(F.col(f"c.{name}"))
    missing = updates.select(*keys).join(current.select(*keys), list(keys), "left_anti")
    return joined.select(*columns), missing


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """insert / update / delete rows that lead from one snapshot to the next."""
    names = [c for c in after.columns if c not in keys]
    old = before.select(*keys, F.struct(*names).alias("old_row"))
    new = after.select(*keys, F.struct(*names).alias("new_row"))
    joined = old.join(new, list(keys), "full_outer")
    change = (
        F.when(F.col("old_row").isNull(), F.lit("insert"))
        .when(F.col("new_row").isNull(), F.lit("delete"))
        .when(~F.col("old_row").eqNullSafe(F.col("new_row")), F.lit("update"))
    )
    return joined.withColumn("change", change).filter(F.col("change").isNotNull())


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by `order`.

    An aggregate, not a window: rows of a key that holds a large share of the
    table are reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*")


# ---- tables on disk ---------------------------------------------------------

class RunConflict(Exception):
    """Another run has finished since this one read the state."""


class TableStore:
    """The three tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _runs(self) -> tuple[dict[int, str], set[int]]:
        """The names of finished runs by number, and the numbers that were only started; one listing."""
        fs, path = self._fs()
        done, started = {}, set()
        if fs.exists(path(f"{self.root}/runs")):
            for entry in fs.listStatus(path(f"{self.root}/runs")):
                number, _, run = entry.getPath().getName().partition(".")
                if run == "started":
                    started.add(int(number))
                else:
                    done[int(number)] = run
        return done, started

    def _snapshots(self) -> list[tuple[int, str, str]]:
        """Number, batch or run, and folder of the finished state snapshots, rising."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/state")):
            return []
        runs, _ = self._runs()
        found = []
        for entry in fs.globStatus(path(f"{self.root}/state/*/_SUCCESS")):
            name = entry.getPath().getParent().getName()
            kind, _, rest = name.partition("=")
            number, _, batch = rest.partition(".")
            if kind == "snapshot" or int(number) in runs:
                found.append((int(number), batch if kind == "snapshot" else runs[int(number)], name))
        return sorted(found)

    def _last_number(self) -> int:
        """The greatest number that a snapshot or run has taken, finished or not; -1 without one."""
        done, started = self._runs()
        return max([-1, *done, *started, *(number for number, _, _ in self._snapshots())])

    def create(self) -> None:
        """Write the empty tables; existing ones are left alone."""
        if not self._snapshots():
            self.write_state(self.spark.createDataFrame([], schemas.STATE))
        fs, path = self._fs()
        for name in ("audit", "history"):
            if not fs.exists(path(f"{self.root}/{name}")):
                self._append(self.spark.createDataFrame([], schemas.TABLES[name]), name)

    def state(self, before: int | None = None) -> DataFrame:
        """The newest snapshot, or the newest one numbered below `before`."""
        done = [name for number, _, name in self._snapshots() if before is None or number < before]
        if not done:
            return self.spark.createDataFrame([], schemas.STATE)
        return self.spark.read.schema(schemas.STATE).parquet(f"{self.root}/state/{done[-1]}")

    def has_batch(self, batch: str) -> bool:
        """Whether a finished snapshot or run was written for this batch."""
        return any(held == batch for _, held, _ in self._snapshots()) or batch in self._runs()[0].values()

    def write_state(self, rows: DataFrame, batch: str = "") -> int:
        """Write the next snapshot; returns its number.

        A number is never used twice, so no reader loses the folder it reads.
        `batch` (letters, digits, "-") is kept with the snapshot: a stream sees
        by it that a repeated batch is already in.
        """
        number = self._last_number() + 1
        name = f"snapshot={number}" + (f".{batch}" if batch else "")
        # a failed run may have left part of this folder; only a finished one counts
        rows.select(*schemas.STATE.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/state/{name}")
        return number

    def version(self) -> int:
        """Number of the newest finished snapshot; -1 without one."""
        return max((number for number, _, _ in self._snapshots()), default=-1)

    def begin(self) -> int:
        """Take the next number for a run."""
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/runs"))
        number = self._last_number() + 1
        while not fs.createNewFile(path(f"{self.root}/runs/{number}.started")):
            number += 1
        return number

    def write_run(self, run: str, base: int, state: DataFrame, audit: DataFrame, history: DataFrame, note: dict | None = None) -> int:
        """Write the three tables of a run, which become visible together; returns its number.

        `run` (letters, digits, "-") names it: see `has_batch`.  `base` is the `version` the run started
        from; if a newer one is there by now, RunConflict is raised and nothing is seen of this run.
        `note` is kept with the run.
        """
        if not re.fullmatch("[A-Za-z0-9-]+", run) or run == "started":
            raise ValueError(f"not a name of a run: {run!r}")
        number = self.begin()
        state.select(*schemas.STATE.fieldNames()).write.parquet(f"{self.root}/state/run={number}")
        for name, rows in (("audit", audit), ("history", history)):
            self._by_day(rows, name).write.partitionBy("day").parquet(f"{self.root}/{name}_of_runs/run={number}")
        if self.version() != base:
            raise RunConflict(f"run {run!r} started from {base}, the store is at {self.version()}")
        fs, path = self._fs()
        begun = path(f"{self.root}/runs/{number}.started")
        out = fs.create(begun, True)
        out.write(json.dumps(note or {}).encode())
        out.close()
        if not fs.rename(begun, path(f"{self.root}/runs/{number}.{run}")):
            raise RunConflict(f"run {run!r} could not be finished")
        return number

    def note(self, run: str) -> dict | None:
        """What was kept with the newest finished run of this name."""
        number = max((n for n, held in self._runs()[0].items() if held == run), default=None)
        if number is None:
            return None
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/runs/{number}.{run}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def retire(self, keep: int = 10) -> int:
        """Delete all state snapshots but the newest `keep`, and what unfinished runs have left; returns how many snapshots went.

        For a time when no reader uses an older one and no run is under way.  A stream looks for its last
        batch only, so keep at least the snapshots written since that batch.
        """
        fs, path = self._fs()
        old = self._snapshots()[:-max(keep, 1)]
        for _, _, name in old:
            fs.delete(path(f"{self.root}/state/{name}"), True)
        for number in self._runs()[1]:
            for part in ("state", "audit_of_runs", "history_of_runs"):
                fs.delete(path(f"{self.root}/{part}/run={number}"), True)
        return len(old)

    def _by_day(self, rows: DataFrame, name: str) -> DataFrame:
        """Shaped rows with their day: few files per day, and several for a day too large for one task."""
        day = {"audit": "scan_ts", "history": "started_at"}[name]
        return rows.select(*schemas.TABLES[name].fieldNames()).withColumn("day", F.to_date(day)).hint("rebalance", F.col("day"))

    def _append(self, rows: DataFrame, name: str) -> None:
        self._by_day(rows, name).write.mode("append").partitionBy("day").parquet(f"{self.root}/{name}")

    def append_audit(self, rows: DataFrame) -> None:
        self._append(rows, "audit")

    def append_history(self, rows: DataFrame) -> None:
        self._append(rows, "history")

    def append_once(self, rows: DataFrame, name: str) -> None:
        """Append the rows whose key the table does not hold yet.

        Only the days between the first and last of `rows` are read: the bounds
        are literals in the filter on the partition column.
        """
        column = {"audit": "scan_ts", "history": "started_at"}[name]
        first, last = rows.select(F.min(F.to_date(column)), F.max(F.to_date(column))).first()
        if first is None:
            return
        held = getattr(self, name)().filter(F.col("day").between(F.lit(first), F.lit(last))).select(*schemas.KEYS[name])
        self._append(rows.join(held, schemas.KEYS[name], "left_anti"), name)

    def _log(self, name: str) -> DataFrame:
        """Rows appended by themselves and those of finished runs; a filter on `day` prunes both."""
        shape = StructType([*schemas.TABLES[name].fields, StructField("day", DateType())])
        alone = self.spark.read.schema(shape).parquet(f"{self.root}/{name}")
        done, started = self._runs()
        if not done:
            return alone
        of_runs = self.spark.read.schema(StructType([*shape.fields, StructField("run", LongType())])).parquet(f"{self.root}/{name}_of_runs")
        return alone.unionByName(of_runs.filter(~F.col("run").isin(*started)).drop("run") if started else of_runs.drop("run"))

    def days(self, name: str) -> list[date]:
        """The days that a table kept by day holds, rising; one listing, no file is opened."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/{name}")):
            return []
        names = [entry.getPath().getName() for entry in fs.listStatus(path(f"{self.root}/{name}"))]
        return sorted(date.fromisoformat(n[4:]) for n in names if re.fullmatch(r"day=\d{4}-\d\d-\d\d", n))

    def audit(self) -> DataFrame:
        return self._log("audit")

    def history(self) -> DataFrame:
        return self._log("history")

    def register_views(self, prefix: str = "") -> None:
        for name in schemas.TABLES:
            getattr(self, name)().createOrReplaceTempView(prefix + name)

    def query(self, sql: str) -> DataFrame:
        """Ad-hoc SQL over the views `state`, `audit` and `history`.

        The names hold for this query only: views of the caller with these names
        are put back, as the query is resolved by then.
        """
        before = {name: self.spark.table(name) for name in schemas.TABLES if self._is_temporary(name)}
        self.register_views()
        try:
            return self.spark.sql(sql)
        finally:
            for name in schemas.TABLES:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    self.spark.catalog.dropTempView(name)

    def _is_temporary(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name) and self.spark.catalog.getTable(name).isTemporary


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Landed page snapshots; a missing page is an empty html with a flag."""
    pages = spark.read.parquet(path)
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.withColumn("html", html).withColumn("is_empty", html == "")
