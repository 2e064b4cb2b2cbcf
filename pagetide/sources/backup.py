"""JSON backup of the tables and a restore that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetide.sources import schemas
from pagetide.sources.tables import TableStore, upsert

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("timestampFormat", ISO).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", ISO).json(path)


def restore(current: DataFrame, path: str, name: str) -> DataFrame:
    """`current` merged with a backup on the table's key: twice equals once."""
    schema = schemas.schema_of(name)
    return upsert(current, read_json(current.sparkSession, path, schema), schemas.KEYS[name])


def export_store(store: TableStore, path: str) -> dict[str, int]:
    """All three tables below `path`, a folder each; rows written by table."""
    counts = {}
    for name, schema in schemas.TABLES.items():
        export_json(getattr(store, name)().select(*schema.fieldNames()), f"{path}/{name}")
        counts[name] = read_json(store.spark, f"{path}/{name}", schema).count()
    return counts


def restore_store(store: TableStore, path: str) -> dict[str, int]:
    """Merges a backup of all three tables into the store; rows read by table.

    State rows take the place of those of the same target, log rows that are
    there already are not added again: twice equals once.
    """
    counts = {}
    for name, schema in schemas.TABLES.items():
        rows = read_json(store.spark, f"{path}/{name}", schema)
        counts[name] = rows.count()
        if name == "state":
            store.write_state(restore(store.state(), f"{path}/{name}", name))
        else:
            store.append_once(rows, name)
    return counts
