"""Foreign SQLite files as a batch source: read only, in ranges of row ids, with simple filters applied by the file's own engine."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Rows of a batch; row ids of one task.
BATCH_ROWS, RANGE_ROWS = 2_000, 200_000
_KINDS = (("INT", T.LongType()), ("BOOL", T.LongType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
_SIGNS = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}


@dataclass
class RowRange(D.InputPartition):
    """Rows of one file with ids in low..high."""

    path: str
    low: int
    high: int


def _local(path: str) -> str:
    """A file's place in the file system, which driver and executors share; SQLite reads no other."""
    return path.removeprefix("file://")


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{_local(path)}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _files(path: str) -> list[str]:
    """The file, or the .sqlite and .db files of a folder."""
    files, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith((".sqlite", ".db")))


class SqliteTable(D.DataSource):
    """Format sqlite_table: the table of that option in the file of the option path, or in each file of that folder.

    Options: table, path, rangeRows. Columns and types are those that the first file declares; values of another
    type than declared are null. Tables without row ids aren't read. Only reads: files are opened as such.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no SQLite file at {self.options['path']}")
        with _open(files[0]) as c:
            columns = c.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        kind = lambda declared: next((k for part, k in _KINDS if part in declared.upper()), T.StringType())
        return T.StructType([T.StructField(x[1], kind(x[2])) for x in columns])

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(D.DataSourceReader):
    def __init__(self, options, schema: T.StructType) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.table, self.schema = options["path"], options["table"], to_arrow_schema(schema)
        self.range_rows = int(options.get("rangerows", RANGE_ROWS))
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        """Comparisons of a column with a number or text, and tests for null, go to the file; Spark keeps the others."""
        for f in filters:
            kind, value = type(f).__name__, getattr(f, "value", None)
            column = ".".join(getattr(f, "attribute", ()))
            if kind in _SIGNS and isinstance(value, (int, float, str)) and not isinstance(value, bool):
                self.where.append((f"{_name(column)} {_SIGNS[kind]} ?", value))
            elif kind == "IsNotNull":
                self.where.append((f"{_name(column)} IS NOT NULL", None))
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        out = []
        for path in _files(self.path):
            with _open(path) as c:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            if low is not None:
                out += [RowRange(path, a, min(a + self.range_rows - 1, high)) for a in range(low, high + 1, self.range_rows)]
        return out or [RowRange("", 1, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        columns = ", ".join(_name(f.name) for f in self.schema)
        where = "".join(f" AND {sql}" for sql, _ in self.where)
        values = [v for sql, v in self.where if sql.endswith("?")]
        with _open(partition.path) as c:
            c.text_factory = lambda b: b.decode("utf-8", "replace")
            rows = c.execute(f"SELECT {columns} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ?{where}", [partition.low, partition.high, *values])
            while batch := rows.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([_fit(v, f.type) for v in col], f.type) for col, f in zip(zip(*batch, strict=True), self.schema, strict=True)], schema=self.schema)


def _fit(value, kind: pa.DataType):
    """A value of the declared type; SQLite lets any row hold any."""
    if pa.types.is_float64(kind):
        return float(value) if isinstance(value, (int, float)) else None
    wanted = int if pa.types.is_int64(kind) else bytes if pa.types.is_binary(kind) else str
    return value if isinstance(value, wanted) else None


def sqlite_table(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def write_sqlite(df: DataFrame, folder: str, table: str) -> None:
    """One file for each partition below a folder that all executors share; a task that runs again replaces its file."""
    names = ", ".join(_name(f.name) + {"bigint": " INTEGER", "double": " REAL", "binary": " BLOB"}.get(f.dataType.simpleString(), " TEXT") for f in df.schema)
    marks, place = ", ".join("?" * len(df.columns)), _local(folder)

    create = f"CREATE TABLE {_name(table)} ({names})"

    def write(batches):
        from pyspark import TaskContext

        os.makedirs(place, exist_ok=True)
        draft, n = f"{place}/.{uuid.uuid4().hex}", 0
        with sqlite3.connect(draft) as c:
            c.execute(create)
            for batch in batches:
                n += batch.num_rows
                c.executemany(f"INSERT INTO {_name(table)} VALUES ({marks})", zip(*(x.to_pylist() for x in batch.columns), strict=True))
        c.close()
        os.replace(draft, f"{place}/part-{TaskContext.get().partitionId():05d}.sqlite")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()
    os.makedirs(place, exist_ok=True)
    if not _files(place):  # a table without partitions still has its columns
        with sqlite3.connect(f"{place}/part-00000.sqlite") as c:
            c.execute(create)
        c.close()
