from __future__ import annotations

import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagetide.sources import backup, schemas, tables, targets


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="pagetide-test-")


def state_row(target, mode="MONTHLY", **more):
    row = {f: None for f in schemas.STATE.fieldNames()}
    row.update(target_id=target, url=f"https://{target}.org/", watch_mode=mode, is_active=True, current_deadlines=[], tracked_links=[],
               no_change_streak=0, error_streak=0, total_scans=0, next_run_at=datetime(2026, 1, 2, 3, 4, 5, 678900))
    row.update(more)
    return tuple(row[f] for f in schemas.STATE.fieldNames())


def states(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.STATE)


def content(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_upsert_twice_equals_once(spark):
    old = states(spark, state_row("a"), state_row("b", "URGENT"))
    new = states(spark, state_row("b", "BIWEEKLY", binary_hash="x"), state_row("c"))
    once = tables.upsert(old, new, ["target_id"])
    assert [(r[0], r[2]) for r in content(once)] == [("a", "MONTHLY"), ("b", "BIWEEKLY"), ("c", "MONTHLY")]
    assert content(tables.upsert(once, new, ["target_id"])) == content(once)


def test_upsert_can_set_null(spark):
    old = states(spark, state_row("a", binary_hash="x", last_error="bad"))
    new = states(spark, state_row("a", binary_hash="x"))
    assert tables.upsert(old, new, ["target_id"]).first()["last_error"] is None


def test_partial_update(spark):
    old = states(spark, state_row("a"), state_row("b"))
    upd = spark.createDataFrame([("a", "URGENT", 1), ("zz", "URGENT", 2)], "target_id string, watch_mode string, bogus int")
    stamp = F.lit("2026-05-05 00:00:00").cast("timestamp")
    new, missing = tables.partial_update(old, upd, ["target_id"], stamp)
    assert [(r["target_id"], r["watch_mode"], r["updated_at"]) for r in new.orderBy("target_id").collect()] == [
        ("a", "URGENT", datetime(2026, 5, 5)), ("b", "MONTHLY", None)]
    assert [r[0] for r in missing.collect()] == ["zz"]


def test_change_feed(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, None)], "k int, v string")
    feed = {r["k"]: r["change"] for r in tables.change_feed(old, new, ["k"]).collect()}
    assert feed == {2: "update", 4: "insert"}
    assert {r["k"]: r["change"] for r in tables.change_feed(new, old, ["k"]).collect()} == {2: "update", 4: "delete"}


def test_store_keeps_snapshots_apart(spark, root):
    store = tables.TableStore(spark, root)
    store.create()
    store.create()
    assert store.state().count() == store.audit().count() == store.history().count() == 0
    assert store.write_state(states(spark, state_row("a"))) == 1
    store.write_state(tables.upsert(store.state(), states(spark, state_row("b")), ["target_id"]))
    assert store.state().count() == 2 and store.state(before=2).count() == 1
    assert store.write_state(states(spark, state_row("c")), "q-2") == 3 and store.has_batch("q-2") and not store.has_batch("q-3")
    assert [r["target_id"] for r in store.state().collect()] == ["c"]
    assert store.retire(keep=2) == 2 and store.state(before=3).count() == 2 and store.retire(keep=2) == 0


def test_query_leaves_the_callers_views_alone(spark, root):
    store = tables.TableStore(spark, root)
    store.create()
    spark.range(3).createOrReplaceTempView("state")
    assert store.query("SELECT count(*) AS n FROM state JOIN audit USING (target_id)").first()["n"] == 0
    assert spark.table("state").count() == 3 and not spark.catalog.tableExists("audit")
    spark.catalog.dropTempView("state")


def test_append_once(spark, root):
    store = tables.TableStore(spark, root)
    store.create()
    def rows(*ids):
        return spark.createDataFrame(
            [(i, "t", datetime(2026, 1, 1 + int(i[1:]) % 3)) for i in ids], "run_id string, target_id string, started_at timestamp"
        ).withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.HISTORY.fields if f.name not in ("run_id", "target_id", "started_at")})
    store.append_once(rows("r1", "r2"), "history")
    store.append_once(rows("r2", "r3", "r4"), "history")
    assert sorted(r["run_id"] for r in store.history().collect()) == ["r1", "r2", "r3", "r4"]
    plans = []
    whole = tables.TableStore._append
    tables.TableStore._append = lambda self, rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString())
    store.append_once(rows("r1", "r9"), "history")
    tables.TableStore._append = whole
    assert "day#" in plans[0] and ">= 2026-01-01" in plans[0] and "<= 2026-01-02" in plans[0]
    assert store.query("SELECT count(*) AS n FROM history WHERE day = DATE'2026-01-02'").first()["n"] == 2


def test_backup_and_restore(spark, root):
    deadline = [(datetime(2026, 3, 1).date(), "paper", 0.9, 'quoted "text"')]
    full = states(spark, state_row("a", "URGENT", current_deadlines=deadline, simhash=-5, tracked_links=[("u", 2.5, datetime(2026, 1, 1))]), state_row("b"))
    backup.export_json(full, root + "/b")
    empty = states(spark)
    once = backup.restore(empty, root + "/b", "state")
    assert content(once) == content(full)
    assert content(backup.restore(once, root + "/b", "state")) == content(full)


def test_backup_and_restore_of_the_whole_store(spark, root):
    store, other = tables.TableStore(spark, root + "/one"), tables.TableStore(spark, root + "/two")
    for s in (store, other):
        s.create()
    store.write_state(states(spark, state_row("a"), state_row("b")))
    rows = spark.createDataFrame([("r1", "a", datetime(2026, 1, 2)), ("r2", "b", datetime(2026, 1, 3))], "run_id string, target_id string, started_at timestamp")
    store.append_once(rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.HISTORY.fields if f.name not in rows.columns}), "history")
    assert backup.export_store(store, root + "/b") == {"state": 2, "audit": 0, "history": 2}
    for _ in range(2):
        assert backup.restore_store(other, root + "/b") == {"state": 2, "audit": 0, "history": 2}
    assert content(other.state()) == content(store.state()) and other.history().count() == 2


def test_nested_lists_as_json(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "[]"), (4, '[{"date":"2026-03-01","type":"paper","confidence":0.9,"source_text":"s"}]')], "i int, j string")
    back = df.select("i", schemas.list_from_json(F.col("j"), schemas.DEADLINES).alias("d"))
    assert [len(r["d"]) for r in back.orderBy("i").collect()] == [0, 0, 0, 1]
    again = back.select("i", schemas.list_to_json(F.col("d"), schemas.DEADLINES).alias("j")).orderBy("i").collect()
    assert [r["j"] for r in again][:3] == ["[]"] * 3 and '"2026-03-01"' in again[3]["j"]


def test_config_violations(spark):
    shape = "target_id string, urls array<string>"
    good = spark.createDataFrame([("a", ["u"])], shape)
    bad = spark.createDataFrame([("a", ["u"]), (None, ["u"]), ("c", None), ("d", [])], shape)
    assert targets.config_violations(good).count() == 0
    assert sorted(r["rule"] for r in targets.config_violations(bad).collect()) == ["empty_urls", "missing_id", "missing_urls"]
    assert [r["rule"] for r in targets.config_violations(spark.createDataFrame([], shape)).collect()] == ["no_targets"]


def test_unknown_table():
    with pytest.raises(ValueError):
        schemas.schema_of("nope")
