"""Stored tables: merges, failed and competing commits, earlier versions, released folders, migration."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.versioned import CommitConflict, VersionedTable, latest

SCHEMA = "k int, a string, n long"


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"a{i}", i) for i in range(40)] + [(None, "none", 0)]
    return VersionedTable.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/t", ["k"], 8)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_updates_inserts_and_deletes(spark, table):
    before = rows(table.read())
    news = spark.createDataFrame([(1, "x", 5), (99, "y", 6), (None, "z", 7), (2, None, None)], SCHEMA)
    table.merge(news, latest(["a"]) | {"n": F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))}, keep=F.coalesce(F.col("new.a"), F.col("old.a")) != "a3")
    got = {r[0]: r[1:] for r in rows(table.read())}
    assert got[1] == ("x", 6) and got[99] == ("y", 6) and got[None] == ("z", 7) and got[2] == (None, 2) and got[5] == ("a5", 5)
    assert rows(table.read(0)) == before and table.versions() == [0, 1]


def test_merge_rewrites_touched_buckets_only(spark, table):
    old = table.head()["folders"]
    table.merge(spark.createDataFrame([(7, "seven", 1)], SCHEMA), latest(["a", "n"]))
    new = table.head()["folders"]
    assert len([b for b in old if old[b] != new[b]]) == 1


def test_no_change_is_no_version(spark, table):
    assert table.merge(spark.createDataFrame([], SCHEMA), latest(["a", "n"])) == 0 and table.versions() == [0]


def test_last_of_equal_keys_counts(spark, table):
    news = spark.createDataFrame([(1, "late", 9), (1, "early", 8), (1, "latest", 10)], SCHEMA)
    table.merge(news, latest(["a", "n"]), order="n")
    assert table.read().where("k = 1").collect() == [(1, "latest", 10)]


def test_failed_merge_leaves_the_table(spark, table):
    before = rows(table.read())
    bad = F.raise_error(F.lit("no")).cast("string")
    with pytest.raises(Exception, match="no"):
        table.merge(spark.createDataFrame([(1, "x", 5)], SCHEMA), {"a": bad})
    assert rows(table.read()) == before and table.versions() == [0]


def test_failed_commit_leaves_the_table(spark, table, monkeypatch):
    before = rows(table.read())
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, head: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([(1, "x", 5)], SCHEMA), latest(["a", "n"]))
    monkeypatch.undo()
    assert rows(table.read()) == before
    table.release()  # what was written for the lost commit goes
    assert rows(table.read()) == before and len(table._names("data")) == 1


def test_two_writers(spark, table):
    other = VersionedTable(spark, table.path)
    stale = other.head()
    table.merge(spark.createDataFrame([(1, "first", 1)], SCHEMA), latest(["a", "n"]))
    with pytest.raises(CommitConflict):
        other._commit(stale | {"version": 1, "operation": "second"})
    assert table.read().where("k = 1").collect() == [(1, "first", 1)]
    assert not [n for n in table._names("log") if n.startswith(".") and not n.endswith(".crc")]


def test_release_and_restore(spark, table):
    first = rows(table.read())
    table.merge(spark.createDataFrame([(1, "x", 1)], SCHEMA), latest(["a", "n"]))
    second = rows(table.read())
    table.restore(0)
    assert rows(table.read()) == first and [o for _, o in table.history()] == ["create", "merge", "restore 0"]
    assert len(table.release(keep=1)) == 1 and table.versions() == [2]
    assert rows(table.read()) == first != second


def test_migration_runs_once_and_keeps_a_backup(spark, table):
    table.migrate(1, {"m": F.col("n") * 2})
    assert table.migrate(1, {"m": F.lit(0)}) == 1
    table.merge(spark.createDataFrame([(1, "x", 1, 77)], SCHEMA + ", m long"), latest(["a", "n", "m"]))
    table.release()
    assert table.versions() == [0, 2] and table.read(0).columns == ["k", "a", "n"]
    assert {r.m for r in table.read().where("k in (1, 2)").collect()} == {77, 4}


def test_empty_table(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/t", ["k"])
    assert table.read().collect() == []
    table.merge(spark.createDataFrame([(1, "x", 5)], SCHEMA), latest(["a", "n"]))
    assert table.read().collect() == [(1, "x", 5)]
