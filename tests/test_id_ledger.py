"""The bitmap ledger equals a plain list of ids; rows and ledger of the table sync change together."""

import random

import pytest
from pyspark.sql import functions as F
from test_sync import live

from loglattice.operators import id_ledger, sync
from loglattice.streaming import committed, table_sync


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def random_ids(spark):
    """A log and a list of synced ids: NULLs, repeats, negative and huge ones, bucket borders."""
    rng = random.Random(5)
    borders = [-(2**63), -32769, -32768, -1, 0, 1, 32767, 32768, 32769, 65536, 2**62]
    ids = borders + [rng.choice([None, rng.randint(-100_000, 300_000), rng.randint(0, 2**60)]) for _ in range(800)]
    ids += ids[:200]
    synced = [rng.choice([None, rng.choice(ids), rng.randint(0, 300_000)]) for _ in range(600)]
    log = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "query_id long, n long").repartition(4)
    return log, spark.createDataFrame([(i,) for i in synced], "query_id long")


def test_equal_to_the_list_of_ids(random_ids):
    log, synced = random_ids
    ledger = id_ledger.bitmap_ledger(synced)
    twice = ledger.union(id_ledger.bitmap_ledger(synced.limit(100)))  # marking twice is marking once
    for some in (ledger, twice):
        assert same(id_ledger.new_rows(log, some), sync.unsynced_batch(log, synced, 10**6))
        assert same(id_ledger.mark_synced_by_bitmap(log, some), sync.mark_synced(log, synced))
        assert id_ledger.sync_status_by_bitmap(log, some).collect() == sync.sync_status(log, synced).collect()
    distinct = synced.where("query_id IS NOT NULL").distinct().count()
    assert id_ledger.ids_in_ledger(id_ledger.merged_ledger(twice)).first()["ids"] == distinct
    batch = id_ledger.unsynced_by_bitmap(log, ledger, 7).collect()
    assert [r["query_id"] for r in batch] == [r["query_id"] for r in sync.unsynced_batch(log, synced, 7).collect()]


def test_empty_sides_and_plan(spark, random_ids):
    log, synced = random_ids
    nothing = id_ledger.bitmap_ledger(synced.limit(0))
    assert id_ledger.new_rows(log, nothing).count() == log.count()
    assert id_ledger.sync_status_by_bitmap(log.limit(0), id_ledger.bitmap_ledger(synced)).first()["total"] == 0
    plan = id_ledger.new_rows(log, id_ledger.bitmap_ledger(synced))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def without_id(spark, n):
    return live(spark, [0] * n).withColumn("query_id", F.lit(None).cast("long"))


def loaded(spark, path):
    tables = table_sync.warehouse_tables(spark, path)
    rows, ledger = tables.read("rows"), tables.read("ledger")
    ids = sorted(r["query_id"] for r in rows.collect())
    assert id_ledger.ids_in_ledger(ledger).first()["ids"] == len(ids)
    assert id_ledger.new_rows(rows, ledger).count() == 0
    return ids


def test_table_sync(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "tables")
    live(spark, range(20)).repartition(10).write.parquet(source)
    first = table_sync.run_sync_table(spark, source, path, str(tmp_path / "c1"), max_files=1).first()
    assert (first["records_fetched"], first["records_loaded"], first["success"]) == (20, 20, True)
    live(spark, [5, 25, 25, 26]).union(without_id(spark, 2)).write.mode("append").parquet(source)
    second = table_sync.run_sync_table(spark, source, path, str(tmp_path / "c1")).first()
    assert (second["records_fetched"], second["records_loaded"]) == (6, 2)
    again = table_sync.run_sync_table(spark, source, path, str(tmp_path / "lost")).first()
    assert (again["records_fetched"], again["records_loaded"]) == (26, 0)
    assert loaded(spark, path) == [*range(20), 25, 26]
    bad = table_sync.run_sync_table(spark, str(tmp_path / "none"), path, str(tmp_path / "c2")).first()
    assert bad["success"] is False


@pytest.mark.parametrize("step", ["ledger", "publish"])
def test_a_crash_leaves_both_or_neither(spark, tmp_path, monkeypatch, step):
    path, write, publish = str(tmp_path), committed.Tables._write, committed.Tables._publish
    tables = table_sync.warehouse_tables(spark, path)
    table_sync.load_into(tables, live(spark, range(4)), 0)

    def crash(self, *a):
        if step == "publish" or a[0] == "ledger":
            raise RuntimeError("driver lost")
        return write(self, *a)

    monkeypatch.setattr(committed.Tables, "_publish" if step == "publish" else "_write", crash)
    with pytest.raises(RuntimeError):
        table_sync.load_into(tables, live(spark, range(2, 8)), 1)
    monkeypatch.undo()
    assert loaded(spark, path) == [0, 1, 2, 3]
    assert table_sync.load_into(tables, live(spark, range(2, 8)), 1) == (6, 4)
    assert table_sync.load_into(tables, live(spark, range(2, 8)), 1) == (6, 0)
    assert loaded(spark, path) == list(range(8))
    assert committed.Tables._publish is publish


def test_streams_that_load_the_same_ids_at_once(spark, tmp_path, monkeypatch):
    tables = table_sync.warehouse_tables(spark, str(tmp_path))
    publish, raced = committed.Tables._publish, []

    def late(self, state):
        if not raced:
            raced.append(True)
            table_sync.load_into(tables, live(spark, [1, 2, 3]), 0, "other")
        return publish(self, state)

    monkeypatch.setattr(committed.Tables, "_publish", late)
    assert table_sync.load_into(tables, live(spark, [2, 3, 4]), 0, "one") == (3, 1)
    assert loaded(spark, str(tmp_path)) == [1, 2, 3, 4]


def test_rows_without_an_id_are_not_loaded(spark, tmp_path):
    from loglattice.streaming import logs

    at = [str(tmp_path / n) for n in ("warehouse", "ledger")]
    batch = without_id(spark, 2).union(live(spark, [1]))
    assert logs.load_batch(batch, 0, *at) == (3, 1)
    assert logs.load_batch(batch, 0, *at, "s1") == (3, 0)
    assert spark.read.parquet(at[0]).select(F.count("query_id")).first()[0] == 1
