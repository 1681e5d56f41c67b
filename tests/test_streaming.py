"""Streaming jobs over several files and a restart, against the same rows as a table."""

from pyspark.sql import functions as F

from sparkloom.streaming import jobs


def test_first_of_each_after_restart(spark, tmp_path):
    table, folder = tmp_path / "pushes", f"file://{tmp_path}/job"
    rows = [("a", 1), ("a", 1), ("b", 1), (None, 1)]
    spark.createDataFrame(rows, "key string, n int").coalesce(1).write.parquet(str(table))
    source = lambda: jobs.first_of_each(jobs.stream_of(spark, str(table), 1), ["key", "n"])
    first = jobs.append_to(source(), folder)
    assert sorted((r.key or "", r.n) for r in first.collect()) == [("", 1), ("a", 1), ("b", 1)]
    spark.createDataFrame([("b", 1), ("c", 1), (None, 1)], "key string, n int").write.mode("append").parquet(str(table))
    again = jobs.append_to(source(), folder)
    assert sorted((r.key or "", r.n) for r in again.collect()) == [("", 1), ("a", 1), ("b", 1), ("c", 1)]


def test_totals_follow_new_files(spark, tmp_path):
    table, folder = tmp_path / "beats", f"file://{tmp_path}/job"
    for n in (2, 3):
        spark.range(n).withColumn("hook", F.lit("h")).write.mode("append").parquet(str(table))
        stream = jobs.stream_of(spark, str(table), 1).groupBy("hook").agg(F.count("*").alias("fired"))
        found = jobs.totals_to(stream, folder).collect()
    assert [(r.hook, r.fired) for r in found] == [("h", 5)]


def test_empty_table(spark, tmp_path):
    table = tmp_path / "none"
    spark.createDataFrame([], "key string").write.parquet(str(table))
    assert jobs.append_to(jobs.first_of_each(jobs.stream_of(spark, str(table)), ["key"]), f"file://{tmp_path}/job").count() == 0


def _at(spark, rows, columns, tmp_path, name):
    df = spark.createDataFrame(rows, columns)
    for c, kind in df.dtypes:
        if c.endswith("at"):
            df = df.withColumn(c, F.timestamp_millis(F.col(c) + 10**12))
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return jobs.stream_of(spark, str(tmp_path / name))


def test_quiet_ends_two_seconds(spark, tmp_path):
    """The last change of a stretch comes out; more than two seconds to the next change part two stretches."""
    rows = [("a", 0, 1), ("a", 1900, 2), ("a", 3800, 3), ("a", 5801, 4), ("b", 100, 5), ("b", 100, 6), (None, 50, 7), ("z", 60_000, 8)]
    stream = _at(spark, rows, "path string, at long, id int", tmp_path, "in")
    got = jobs.append_to(jobs.quiet_ends(stream, "path", "at", ["id"]), f"file://{tmp_path}/job")
    assert sorted((r.path or "", r.id, r.changes) for r in got.collect()) == [("", 7, 1), ("a", 3, 3), ("a", 4, 1), ("b", 6, 2)]


def test_quiet_ends_over_a_restart(spark, tmp_path):
    """A stretch that the first run leaves open goes on in the second one."""
    folder = f"file://{tmp_path}/job"
    for rows in ([("a", 0, 1), ("a", 1000, 2)], [("a", 2000, 3), ("z", 50_000, 4)], [("z", 90_000, 5)]):
        df = spark.createDataFrame(rows, "path string, at long, id int").withColumn("at", F.timestamp_millis("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.append_to(jobs.quiet_ends(jobs.stream_of(spark, str(tmp_path / "in")), "path", "at", ["id"]), folder)
    assert sorted((r.path, r.id, r.changes) for r in got.collect()) == [("a", 3, 3), ("z", 4, 1)]


def test_offers_that_expire(spark, tmp_path):
    day = 86_400_000
    offers = _at(spark, [("k", 1, 0), ("k", 2, 5 * day), ("m", 3, 0), (None, 4, 0), ("q", 5, 9 * day)], "k string, offer_id int, offered_at long", tmp_path, "offers")
    seen = _at(spark, [("k", 1000), ("k", 6 * day + 1), ("x", 9 * day)], "k string, seen_at long", tmp_path, "seen")
    got = jobs.append_to(jobs.offered(offers, seen, ["k"]), f"file://{tmp_path}/job")
    assert sorted((r.offer_id, r.seen_at is not None) for r in got.collect()) == [(1, True), (2, False), (3, False), (4, False)]


def test_newest_draft_stays(spark, tmp_path):
    folder = f"file://{tmp_path}/job"
    for rows in ([("a", 5, 1), ("b", 1, 2)], [("a", 3, 9), ("b", 2, 3)], [("a", 5, 4), (None, 1, 1)]):
        spark.createDataFrame(rows, "e string, w int, d int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.newest_to(jobs.stream_of(spark, str(tmp_path / "in"), 1), "e", "w", "d", folder)
    assert sorted((r.e or "", r.written, r.kept, r.drafts) for r in got.collect()) == [("", 1, 1, 1), ("a", 5, 4, 3), ("b", 2, 3, 2)]
