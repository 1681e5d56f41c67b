"""Tables that are changed in place: merges by key rewrite only the buckets they touch, and every commit is a version.

Rows lie in buckets by a hash of their keys. A version is a small file that names each bucket's folder;
a merge reads the touched buckets, joins the changes, writes new folders, and commits by giving the
next version's file its name, which only one writer can. What fails before that leaves the table as
it was. Earlier versions stay readable until release() drops them and the folders nobody names any more.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.work import file_system, rename_new

BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer has committed the version that a change was to become."""


class VersionedTable:
    """A table at a folder that driver and executors share; create() makes one, the constructor opens it.

    Keys may be null: null equals null. The number of buckets is fixed when the table is made: it
    bounds the list that a version holds, and a bucket is the least that a change rewrites.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 16) -> VersionedTable:
        """A table with the rows of df, whose keys differ, as version 0."""
        table = cls(df.sparkSession, path)
        head = {"version": 0, "operation": "create", "keys": keys, "buckets": buckets, "level": 0, "pinned": []}
        table._commit(head | {"schema": df.schema.json(), "folders": table._write(df, keys, buckets)})
        return table

    # what is there

    def _fs(self, path: str):
        return file_system(self.spark, path)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[: -len(".json")]) for n in self._names("log") if n.endswith(".json") and n[0] != "."]

    def head(self, version: int | None = None) -> dict:
        """What a version holds: its number, operation, keys, schema, level of migration and the folder of each bucket."""
        if version is None:
            version = self.versions()[-1]
        fs, at = self._fs(f"{self.path}/log/{version:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def history(self) -> list[tuple[int, str]]:
        return [(v, self.head(v)["operation"]) for v in self.versions()]

    def read(self, version: int | None = None) -> DataFrame:
        """The table as a version has it; the last one if none is named."""
        head = self.head(version)
        return self._rows(head, head["folders"].values())

    def _rows(self, head: dict, folders) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(head["schema"]))
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # changes

    def merge(self, changes: DataFrame, values: dict[str, Column], keep: Column | None = None, order: str | None = None, operation: str = "merge") -> int:
        """Joins changes by key and gives the number of the new version.

        values: each column that is not a key, made from old.* and new.*; in rows that only one side has, the other's columns
        are null, and has_old and has_new say which are there. keep: rows for which it isn't true go. Of changes with equal
        keys the last by order counts; without an order they must differ. No changes, no new version.
        """
        head = self.head()
        keys, schema = head["keys"], T.StructType.fromJson(json.loads(head["schema"]))
        bucket = _bucket(keys, head["buckets"])
        if order:
            changes = changes.withColumn("_last", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_last = 1").drop("_last")
        touched = sorted(r[0] for r in changes.select(bucket.alias("b")).distinct().collect())  # at most the number of buckets
        if not touched:
            return head["version"]
        named = {str(b): f for b, f in head["folders"].items() if int(b) in set(touched)}
        old = self._rows(head, named.values()).withColumn("_old", F.lit(True)).alias("old")
        new = changes.withColumn("_new", F.lit(True)).alias("new")
        on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        both = old.join(new, on, "full").withColumns({"has_old": F.coalesce("_old", F.lit(False)), "has_new": F.coalesce("_new", F.lit(False))})
        if keep is not None:
            both = both.where(F.coalesce(keep, F.lit(False)))
        of = {k: F.when(F.col("has_new"), F.col(f"new.{k}")).otherwise(F.col(f"old.{k}")) for k in keys} | values
        rows = both.select(*(of.get(f.name, F.col(f"old.{f.name}")).cast(f.dataType).alias(f.name) for f in schema))
        folders = {b: f for b, f in head["folders"].items() if b not in named} | self._write(rows, keys, head["buckets"])
        return self._commit(head | {"version": head["version"] + 1, "operation": operation, "folders": folders})

    def migrate(self, level: int, add: dict[str, Column]) -> int:
        """Adds columns made from the old ones, once for each level; the version before is pinned as the backup."""
        head = self.head()
        if head["level"] >= level:
            return head["version"]
        rows = self.read(head["version"]).withColumns(add)
        change = {"version": head["version"] + 1, "operation": f"migrate to {level}", "level": level, "pinned": [*head["pinned"], head["version"]]}
        return self._commit(head | change | {"schema": rows.schema.json(), "folders": self._write(rows, head["keys"], head["buckets"])})

    def restore(self, version: int) -> int:
        """The rows of an earlier version as a new one; nothing is written but its list."""
        head, old = self.head(), self.head(version)
        return self._commit(old | {"version": head["version"] + 1, "operation": f"restore {version}", "pinned": head["pinned"]})

    def release(self, keep: int = 1) -> list[str]:
        """Drops all versions but the last so many and the pinned ones, and the folders that no version names any more.

        Writes that were never committed go too, so no writer may be at work meanwhile.
        """
        versions = self.versions()
        pinned = set(self.head()["pinned"])
        gone = [v for v in versions[:-keep] if v not in pinned]
        for v in gone:
            fs, at = self._fs(f"{self.path}/log/{v:012d}.json")
            fs.delete(at, False)
        named = {f for v in self.versions() for f in self.head(v)["folders"].values()}
        dropped = []
        for commit in self._names("data"):
            for part in self._names(f"data/{commit}"):
                if part.startswith(BUCKET) and f"{commit}/{part}" not in named:
                    dropped.append(f"{commit}/{part}")
            if not any(f.startswith(f"{commit}/") for f in named):
                fs, at = self._fs(f"{self.path}/data/{commit}")
                fs.delete(at, True)
        for part in dropped:
            fs, at = self._fs(f"{self.path}/data/{part}")
            fs.delete(at, True)
        return dropped

    # how

    def _write(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Writes rows in a folder of their own, and names the folder of each bucket that has any."""
        commit = uuid.uuid4().hex
        rows.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{commit}")
        return {n.split("=")[1]: f"{commit}/{n}" for n in self._names(f"data/{commit}") if n.startswith(BUCKET)}

    def _commit(self, head: dict) -> int:
        """Writes the version's file under another name and gives it its own, which fails if there is one."""
        draft, name = f"{self.path}/log/.{uuid.uuid4().hex}", f"{self.path}/log/{head['version']:012d}.json"
        fs, at = self._fs(draft)
        out = fs.create(at, False)
        try:
            out.write(bytearray(json.dumps(head).encode()))
        finally:
            out.close()
        if not rename_new(self.spark, draft, name):
            fs.delete(at, False)
            raise CommitConflict(name)
        return head["version"]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def latest(columns: list[str]) -> dict[str, Column]:
    """For merge(): each column is the change's where there is one, else the old."""
    return {c: F.when(F.col("has_new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in columns}

