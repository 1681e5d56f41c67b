"""Streaming jobs: the delivery operators on a stream of files, with their state in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.work import shared_base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors share files."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A table's files as a stream, with the table's schema. The table is a folder or a single file.

    A stream takes a path without wildcards for a folder; in braces the name stands for either.
    """
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{name}}}")


def first_of_each(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; keys are kept for ever, so a late copy is still a copy."""
    return stream.dropDuplicates(keys)


def append_to(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what is there; rows are written exactly once, also after a restart from the same folder."""
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def totals_to(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an aggregation over what is there; every batch writes the whole table under its number, and the last one is read.

    Readers of an earlier batch keep it; a replayed batch writes its own folder again. For small results.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    sink = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state")
    sink.outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], stream.schema)
    last = max(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path))
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch={last}")


def confirmed(offers: DataFrame, seen: DataFrame, keys: list[str], within: str = "1 day") -> DataFrame:
    """Offers (keys, offer_id, offered_at) joined with sights (keys, seen_at) within a day, both streams.

    Watermarks of a day on both sides bound the state: an offer that nobody confirmed in time leaves it.
    """
    o = offers.withWatermark("offered_at", within).alias("o")
    s = seen.withWatermark("seen_at", within).alias("s")
    on = F.expr(" and ".join(f"o.{k} = s.{k}" for k in keys) + f" and s.seen_at >= o.offered_at and s.seen_at <= o.offered_at + interval {within}")
    return o.join(s, on).select("o.offer_id", "s.seen_at")


def debounced(stream: DataFrame, path: str, at: str, within: str = "2 seconds") -> DataFrame:
    """The first change of a path in each stretch of time; later ones that follow within it are dropped by state that expires."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([path])


def quiet_ends(stream: DataFrame, path: str, at: str, values: list[str], gap: str = "2 seconds", late: str = "2 seconds") -> DataFrame:
    """path, the values of the last change, last_at and changes of each stretch of changes that are no more than gap apart.

    A stretch comes out when event time says that it is over: gap after its last change, and late for changes
    that arrive out of order. The first of the values decides between changes of one moment. State holds open stretches only.
    """
    last = F.max(F.struct(F.col(at).alias("last_at"), *values)).alias("last")
    stretches = stream.withWatermark(at, late).groupBy(F.col(path), F.session_window(at, gap)).agg(last, F.count("*").alias("changes"))
    return stretches.select(path, *(F.col(f"last.{v}").alias(v) for v in values), "changes", "last.last_at")


def offered(offers: DataFrame, seen: DataFrame, keys: list[str], within: str = "1 day") -> DataFrame:
    """Offers joined with sights as confirmed() does, and those that nobody confirmed in time, with null, when their time is over."""
    o = offers.withWatermark("offered_at", "0 seconds").alias("o")
    s = seen.withWatermark("seen_at", "0 seconds").alias("s")
    on = F.expr(" and ".join(f"o.{k} = s.{k}" for k in keys) + f" and s.seen_at >= o.offered_at and s.seen_at <= o.offered_at + interval {within}")
    return o.join(s, on, "left_outer").select("o.offer_id", "s.seen_at")


def newest_to(drafts: DataFrame, key: str, written: str, draft: str, folder: str) -> DataFrame:
    """key, written, kept, drafts: the draft written last, whatever the order in which drafts come, and how many came.

    The state of a key is the newest draft; of drafts of one time the greater id stays. Every batch writes
    the keys it changed with its number, so a replayed batch writes the same again.
    """
    newest = drafts.groupBy(key).agg(F.max(F.struct(F.col(written).alias("written"), F.col(draft).alias("kept"))).alias("newest"), F.count("*").alias("drafts"))

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    sink = newest.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state")
    sink.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    spark = drafts.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], newest.schema).select(key, "newest.*", "drafts")
    changed = spark.read.schema(newest.schema.add("batch", "integer")).parquet(f"{folder}/rows")
    last = changed.groupBy(key).agg(F.max_by("newest", "batch").alias("newest"), F.max_by("drafts", "batch").alias("drafts"))
    return last.select(key, "newest.*", "drafts")


def with_seconds(stream: DataFrame) -> DataFrame:
    return stream.withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))
