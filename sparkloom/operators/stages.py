"""Pipelines of stages that can be stopped: each stage's table is written once, and a ledger says from what.

A stage is a function of earlier tables. Its mark is a digest of its name, its revision and the marks of
what it reads; a table that was finished under the same mark is taken from the ledger, so a run that
was stopped goes on behind its last finished stage, and a changed input redoes just what depends on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.sources.work import file_system


@dataclass(frozen=True)
class Stage:
    """name, the tables it needs (inputs or earlier stages), and the function of them; a new revision redoes it."""

    name: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    revision: int = 1


class Pipeline:
    """Stages in their order, in a folder that a later run names again."""

    def __init__(self, spark: SparkSession, folder: str, stages: list[Stage]) -> None:
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages
        known: set[str] = set()
        for s in stages:
            if s.name in known:
                raise ValueError(f"two stages are named {s.name}")
            known.add(s.name)

    def _at(self, name: str):
        return file_system(self.spark, f"{self.folder}/{name}")

    def entry(self, name: str, mark: str) -> dict | None:
        """What the ledger has of a stage that was finished under a mark."""
        fs, path = self._at(f"ledger/{name}-{mark[:32]}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _record(self, name: str, mark: str, what: dict) -> None:
        """The entry gets its name when it is whole."""
        draft_fs, draft = self._at(f"ledger/.{name}-{mark[:32]}")
        out = draft_fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()
        draft_fs.rename(draft, self._at(f"ledger/{name}-{mark[:32]}.json")[1])

    def run(self, inputs: dict[str, tuple[DataFrame, str]], stop_after: str | None = None) -> tuple[dict[str, DataFrame], list[dict]]:
        """Tables by name, and for each stage what the ledger has: name, mark, needs, rows, and whether this run made it.

        inputs: tables with their marks (as of files_mark). A stage's table is written before its entry, so a run
        that ends between the two writes that table again.
        """
        tables = {name: df for name, (df, _) in inputs.items()}
        marks = {name: mark for name, (_, mark) in inputs.items()}
        ledger = []
        for stage in self.stages:
            mark = hashlib.sha256(repr((stage.name, stage.revision, [(n, marks[n]) for n in stage.needs])).encode()).hexdigest()
            path = f"{self.folder}/tables/{stage.name}-{mark[:32]}"
            entry = self.entry(stage.name, mark)
            made = entry is None
            if made:
                stage.run(*(tables[n] for n in stage.needs)).write.mode("overwrite").parquet(path)
                rows = self.spark.read.parquet(path)
                entry = {"stage": stage.name, "mark": mark, "needs": list(stage.needs), "rows": rows.count(), "schema": rows.schema.json()}
                self._record(stage.name, mark, entry)
            tables[stage.name] = self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(path)
            marks[stage.name] = mark
            ledger.append(entry | {"made": made})
            if stage.name == stop_after:
                break
        return tables, ledger
