"""Shared helpers of the training-data operators: work tables, filters of fixed size, word blocks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the vectorised kernels take at a time; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: The same for kernels on words, and of the bytes that are hashed at a time: a byte takes some forty at work, and workers keep what they took.
WORD_BLOCK_BYTES = 1 << 19
BLOOM_BITS, MOST_BLOOM_BITS = 1 << 26, 1 << 29
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """Written intermediate tables in the cluster's shared folder.

    The folder is spark.checkpoint.dir; where that is unset, a local session (tests) takes a folder
    beside the warehouse and a cluster is refused. Tables survive lost executors and cut the
    lineage. A folder of its own goes when the driver ends, as results that are still to be read need
    it; one that the caller names stays, with all in it, so that a later run can go on from it.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        self.spark, self.named = spark, folder is not None
        self.base = folder.rstrip("/") if folder else f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._marked = False

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _at(self, path: str):
        """The file system of a path and the path there."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _goes_at_exit(self) -> None:
        if not self.named and not self._marked:
            fs, path = self._at(self.base)
            self._marked = bool(fs.deleteOnExit(path))

    def has(self, name: str) -> bool:
        fs, path = self._at(self.path(name))
        return bool(fs.exists(path))

    def finished(self, name: str) -> bool:
        """True if the table was written whole."""
        fs, path = self._at(self.path(name) + "/_SUCCESS")
        return bool(fs.exists(path))

    def table(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """Writes df, partitioned by a column if one is named, and reads it back; the shuffle files of its making go when it is written."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", codec).mode("overwrite").parquet(self.path(name), partitionBy=by)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self._goes_at_exit()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def once(self, df: DataFrame, name: str) -> DataFrame:
        """The table as an earlier run wrote it whole, or else table()."""
        if self.named and self.finished(name):
            return self.spark.read.schema(df.schema).parquet(self.path(name))
        return self.table(df, name)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._at(self.path(name))
            fs.delete(path, True)


def unused(names: list[str], columns: list[str]) -> list[str]:
    """The names, each with underscores before it until no column has it; Spark's names don't tell case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bloom_size(n: int) -> int:
    """Bits for n keys, about ten for each: BLOOM_BITS at least, MOST_BLOOM_BITS (64 MB) at most."""
    bits = BLOOM_BITS
    while bits < 10 * n and bits < MOST_BLOOM_BITS:
        bits *= 2
    return bits


def bloom_bits(keys: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of a long column, as bytes; its size is fixed by bits, whatever the number of keys.

    The bit-or runs as an ordinary aggregation, so the driver receives at most bits / 64 words.
    A full filter lets everything pass: callers always follow it with an exact join.
    """
    places = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(bits - 1)) for s in (0, 31))))
    words = (
        keys.select(places.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out


def bloom_hits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where the filter may hold the key (64-bit integers)."""
    keys, top = keys.astype(np.uint64), np.uint64(len(words) * 64 - 1)
    hit = np.ones(len(keys), bool)
    for s in (0, 31):
        p = (keys >> np.uint64(s)) & top
        hit &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


def shared(spark: SparkSession, array: np.ndarray):
    """A broadcast of an array whose size its caller bounds."""
    return spark.sparkContext.broadcast(array)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty; without decoding."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def utf8_bytes(column: pa.Array) -> list[bytes]:
    """As text_bytes; what isn't UTF-8 gets a replacement character for each bad part. Columns are checked as a whole first."""
    texts = text_bytes(column)
    try:
        column.cast(pa.large_string()).validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return [t.decode("utf-8", "replace").encode() for t in texts]


def blocks(sizes: list[int], limit: int = BLOCK_BYTES):
    """Ranges of consecutive rows with at most limit bytes each, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 12)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash modulo 2**64 of values[starts:ends] for each range, from one prefix sum."""
    up, down = powers(base, len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M1)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, limit: int = WORD_BLOCK_BYTES) -> np.ndarray:
    """range_hashes of ranges of bytes (each counted one higher) with ascending starts, those of about limit bytes at a time."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + limit))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        out[i:j] = range_hashes(data[lo:hi].astype(np.uint64) + np.uint64(1), starts[i:j] - lo, ends[i:j] - lo, base)
        i = j
    return out


class Words:
    """The words of some documents: runs of bytes other than space, tab and line breaks 0x0A-0x0D.

    data has all documents' words with one space between; starts and ends are byte places,
    doc is each word's document, first[d] its first word's index (len: one more than documents).
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.norm = [b" ".join(t.split()) for t in texts]
        self.data = b" ".join(self.norm)
        array = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(t) for t in self.norm], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        spaces = np.flatnonzero(array == 32)
        # a document without words leaves only its separator: an empty word, dropped below
        starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(array)]])
        keep = ends > starts
        self.starts, self.ends = starts[keep].astype(np.int64), ends[keep].astype(np.int64)
        self.first = np.searchsorted(self.starts, np.append(begin, len(array) + 1))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.array = array

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """A 64-bit hash of each word."""
        return byte_hashes(self.array, self.starts, self.ends, base)

    def text(self, start: int, end: int) -> bytes:
        """Words start to end (exclusive) with one space between."""
        return self.data[self.starts[start] : self.ends[end - 1]] if end > start else b""


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most 1,000 rows at a time in this session: texts are long, and the default is 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def located(work: Work, docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with each row's locator, and the names of its two columns: the row's file and its place there.

    The names are ones that docs doesn't have. What isn't read from files is written first.
    """
    file, row = unused(["_file", "_row"], docs.columns)
    place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    try:
        return docs.select("*", *place), file, row
    except Exception as e:
        if "_metadata" not in str(e):
            raise
        return work.once(docs, "content").select("*", *place), file, row


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))
