"""Exact deduplication as a stateful stream: DataFrame operations only.

The digests of all rows are a stream. Its state is kept on disk (RocksDB), keyed by digest and
without expiry; for each digest it retains how many rows had it, and of the row that stays its
stable id and the locator of its content. Rows that hit a digest are compared with the retained
content byte by byte; a row whose digest agrees but whose bytes differ is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Work, located

#: Characters that don't count: [\x20\x09-\x0D].
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The stream of digests comes in this many micro-batches or more, each of at most so many files.
LEAST_BATCHES, MOST_FILES = 4, 2_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _stay() -> list[Column]:
    """What the state holds for each digest: the smallest of (-code points, no id, id, locator), and the count."""
    return [F.min("rank").alias("best"), F.count("*").alias("group_size")]


def save_states(batch: DataFrame, number: int, folder: str) -> None:
    """What a micro-batch changed, in a folder with its number: a replayed batch writes the same folder again."""
    batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def stateful_groups(work: Work, digests: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """digest, best, group_size after the whole stream of written digests has run through the state.

    The stream comes in micro-batches of a quarter of the files, of MOST_FILES at most, so most hits
    are found in the state that earlier batches left. Every micro-batch writes the keys it changed
    with its number; the last value of a key holds. A stream that was stopped goes on after its last
    finished batch if work has a folder that the caller named.
    """
    spark = digests.sparkSession
    files = files_per_batch or max(1, min(MOST_FILES, -(-len(digests.inputFiles()) // LEAST_BATCHES)))
    source = spark.readStream.schema(digests.schema).option("maxFilesPerTrigger", files)
    states = source.parquet(work.path("digests")).groupBy("digest").agg(*_stay())
    folder = work.path("states")
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        query = states.writeStream.outputMode("update").option("checkpointLocation", work.path("stream")).foreachBatch(lambda batch, number: save_states(batch, number, folder)).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    schema = states.schema.add("batch", "integer")
    if not work.has("states"):  # no file in the stream: an empty table
        return spark.createDataFrame([], states.schema)
    changed = spark.read.schema(schema).parquet(folder)
    return changed.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max_by("group_size", "batch").alias("group_size"))


def keep_first(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows that stay, with all columns of docs, whatever their names."""
    work = Work(docs.sparkSession, "exact", folder)
    source, file, row = located(work, docs)
    found = _duplicates(work, source.select("doc_id", "text", F.col(file).alias("file"), F.col(row).alias("row")), None)
    gone = found.where("not kept").select(F.col("file").alias(file), F.col("row").alias(row))
    return source.join(gone, [file, row], "left_anti").select(*docs.columns)


def exact_duplicates(docs: DataFrame, files_per_batch: int | None = None, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, the dropped ones too.

    Texts are equal if identical without white space; null counts as empty. Of equal texts the
    row with the most code points stays, then the one with the smallest doc_id (null ids last),
    then the first by locator: of repeated rows exactly one stays. Needs doc_id and text only.
    With a folder, which belongs to one state of one table, a run that was stopped goes on where it
    ended: written digests, the stream's checkpoint and state, and groups are taken from there.
    """
    work = Work(docs.sparkSession, "exact", folder)
    source, file, row = located(work, docs.select("doc_id", "text"))
    return _duplicates(work, source.select("doc_id", "text", F.col(file).alias("file"), F.col(row).alias("row")), files_per_batch)


def _duplicates(work: Work, source: DataFrame, files_per_batch: int | None) -> DataFrame:
    text = normalised(F.col("text"))
    rank = F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    rows = work.once(source.select("doc_id", F.sha2(text, 256).alias("digest"), rank.alias("rank")), "digests")
    if work.named and work.finished("groups"):
        groups = work.spark.read.parquet(work.path("groups"))
    else:
        groups = work.table(stateful_groups(work, rows, files_per_batch), "groups")
        if not work.named:
            work.drop("stream", "states")
    hits = groups.where("group_size > 1")

    # full bytes: rows of groups with several members against the content their locator names
    texts = source.select("file", "row", F.sha2(text, 256).alias("digest"), text.alias("norm"))
    members = texts.join(hits.select("digest", "best"), "digest")
    is_best = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    members = work.table(members.select("digest", "norm", "file", "row", is_best.alias("is_best")), "members")
    content = members.where("is_best").select("digest", F.col("norm").alias("content"))
    differ = members.join(content, "digest").where("norm <> content").select("digest", "file", "row", F.sha2("norm", 512).alias("other"))
    differ = work.table(differ, "differ")
    work.drop("members")

    if differ.limit(1).count():
        keyed = rows.join(differ, (rows.digest == differ.digest) & (rows.rank.file == differ.file) & (rows.rank.row == differ.row), "left")
        keyed = keyed.select("doc_id", rows.digest, "rank", F.coalesce("other", rows.digest).alias("group"))
        rows = work.table(keyed, "keyed")
        groups = work.table(rows.groupBy(F.col("group").alias("digest")).agg(*_stay()), "regrouped")
    else:
        rows = rows.withColumn("group", F.col("digest"))
    found = groups.select(F.col("digest").alias("group"), "best", "group_size")
    return rows.join(found, "group").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("rank.file") == F.col("best.file")) & (F.col("rank.row") == F.col("best.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("rank.file").alias("file"),
        F.col("rank.row").alias("row"),
        F.col("best.file").alias("keep_file"),
        F.col("best.row").alias("keep_row"),
    )
