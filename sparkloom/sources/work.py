"""Written intermediate tables: they cut the lineage of iterative operators and survive lost executors."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder beside the warehouse in a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return base.rstrip("/")


class Tables:
    """Tables in a folder of their own, which goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.n = spark, f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame, rows_a_file: int = 0) -> DataFrame:
        path = f"{self.base}/{self.n}"
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
        if not self.n:
            jvm = self.spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(self.base)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def rename_new(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a file or folder; False, and nothing happens, if the new name is taken."""
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, old)
    _, to = file_system(spark, new)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(at, to, none)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    return True


def published(spark: SparkSession, name: str, make: Callable[[str], None]) -> str:
    """The folder of that name in the shared folder, which make(folder) fills if it isn't there yet.

    It is made under another name and renamed when it is whole, so several sessions may make it at once: the first one's
    stays, and nobody reads a part of it. It stays when the session ends.
    """
    base = f"{shared_base(spark)}/{name}"
    fs, at = file_system(spark, base)
    if not fs.exists(at):
        draft = f"{base}.{uuid.uuid4().hex}"
        make(draft)
        if not rename_new(spark, draft, base):
            fs.delete(file_system(spark, draft)[1], True)
    return base


def files_mark(spark: SparkSession, df: DataFrame) -> str:
    """A digest of the files that a table is read from, with their sizes and times; each folder is listed once."""
    files, found = sorted(df.inputFiles()), {}
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        fs, at = file_system(spark, folder)
        for s in fs.listStatus(at):
            found[s.getPath().toUri().getPath()] = (s.getLen(), s.getModificationTime())
    names = [file_system(spark, f)[1].toUri().getPath() for f in files]
    return hashlib.sha256(repr([(n, found.get(n)) for n in names]).encode()).hexdigest()
