"""Foreign SQLite files: ranges of row ids, filters, odd values, and that nothing is written."""

import sqlite3

import pytest

from sparkloom.sources.sqlite import sqlite_table, write_sqlite


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "store.db"
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "my turns" (id INTEGER PRIMARY KEY, role TEXT, body TEXT, score REAL, raw BLOB, "odd name" VARCHAR(9))')
        rows = [(i * 3 + 5, ["user", "assistant", None][i % 3], f"t{i}", i / 2, bytes([i % 256]), "x") for i in range(500)]
        c.executemany('INSERT INTO "my turns" VALUES (?, ?, ?, ?, ?, ?)', rows)
        c.execute("INSERT INTO \"my turns\" VALUES (9000, 7, x'ff', 'no number', NULL, NULL)")
    c.close()
    return path, rows


def test_reads_all_in_ranges(spark, file):
    path, rows = file
    df = sqlite_table(spark, str(path), "my turns", rangeRows="100")
    assert df.dtypes == [("id", "bigint"), ("role", "string"), ("body", "string"), ("score", "double"), ("raw", "binary"), ("odd name", "string")]
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4] or b""), r[5]) for r in df.collect())
    assert got[:-1] == rows and got[-1] == (9000, "7", None, None, b"", None)  # a text column stores a number as text
    assert df.rdd.getNumPartitions() > 10


def test_filters_reach_the_file(spark, file):
    path, rows = file
    df = sqlite_table(spark, f"file://{path}", "my turns").where("role = 'assistant' and id > 1000 and body like '%7' and score is not null")
    assert sorted(r.id for r in df.collect()) == sorted(r[0] for r in rows if r[1] == "assistant" and r[0] > 1000 and r[2].endswith("7"))


def test_only_reads(file):
    from sparkloom.sources.sqlite import _open

    with pytest.raises(sqlite3.OperationalError), _open(str(file[0])) as c:
        c.execute('DELETE FROM "my turns"')


def test_folder_round_trip_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"é{i}", i / 3) for i in range(100)], "a long, b string, c double").repartition(3)
    write_sqlite(df, f"file://{tmp_path}/out", "t")
    assert sorted(map(tuple, sqlite_table(spark, f"file://{tmp_path}/out", "t").collect())) == sorted(map(tuple, df.collect()))
    write_sqlite(df.limit(0), f"file://{tmp_path}/none", "t")
    assert sqlite_table(spark, f"file://{tmp_path}/none", "t").collect() == []
    with pytest.raises(Exception, match="no SQLite file"):
        sqlite_table(spark, f"file://{tmp_path}/nothing", "t").collect()
