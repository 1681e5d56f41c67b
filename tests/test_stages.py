"""Pipelines of stages: a stopped run goes on, a changed input redoes what depends on it, a half-written table is written again."""

import shutil

import pytest

from sparkloom.operators.stages import Pipeline, Stage
from sparkloom.sources.work import files_mark


def stages(log, fail=()):
    def step(name, f):
        def run(*tables):
            log.append(name)
            if name in fail:
                raise RuntimeError(name)
            return f(*tables)

        return run

    return [
        Stage("double", ("a",), step("double", lambda a: a.selectExpr("id * 2 as id"))),
        Stage("other", ("b",), step("other", lambda b: b.selectExpr("id + 100 as id"))),
        Stage("both", ("double", "other"), step("both", lambda x, y: x.union(y))),
    ]


def ids(tables, name="both"):
    return sorted(r.id for r in tables[name].collect())


def test_resumes_after_a_failure(spark, tmp_path):
    inputs = {"a": (spark.range(3), "a1"), "b": (spark.range(2), "b1")}
    log, folder = [], f"file://{tmp_path}/p"
    with pytest.raises(RuntimeError):
        Pipeline(spark, folder, stages(log, fail=("both",))).run(inputs)
    tables, ledger = Pipeline(spark, folder, stages(log)).run(inputs)
    assert log == ["double", "other", "both", "both"] and [e["made"] for e in ledger] == [False, False, True]
    assert ids(tables) == [0, 2, 4, 100, 101] and [e["rows"] for e in ledger] == [3, 2, 5]
    again, ledger = Pipeline(spark, folder, stages(log)).run(inputs)
    assert not any(e["made"] for e in ledger) and ids(again) == ids(tables) and len(log) == 4


def test_changed_input_redoes_what_depends_on_it(spark, tmp_path):
    log, folder = [], f"file://{tmp_path}/p"
    Pipeline(spark, folder, stages(log)).run({"a": (spark.range(3), "a1"), "b": (spark.range(2), "b1")})
    log.clear()
    tables, _ = Pipeline(spark, folder, stages(log)).run({"a": (spark.range(3), "a1"), "b": (spark.range(1), "b2")})
    assert log == ["other", "both"] and ids(tables) == [0, 2, 4, 100]


def test_table_without_an_entry_is_written_again(spark, tmp_path):
    inputs = {"a": (spark.range(3), "a1"), "b": (spark.range(2), "b1")}
    log, folder = [], f"file://{tmp_path}/p"
    Pipeline(spark, folder, stages(log)).run(inputs, stop_after="other")
    (entry,) = (tmp_path / "p" / "ledger").glob("other-*.json")
    entry.unlink()
    part = next((tmp_path / "p" / "tables").glob("other-*"))
    shutil.rmtree(part)
    part.mkdir()
    log.clear()
    tables, _ = Pipeline(spark, folder, stages(log)).run(inputs)
    assert log == ["other", "both"] and ids(tables) == [0, 2, 4, 100, 101]


def test_files_mark_follows_files(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    first = files_mark(spark, spark.read.parquet(f"{tmp_path}/t"))
    assert first == files_mark(spark, spark.read.parquet(f"{tmp_path}/t"))
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert first != files_mark(spark, spark.read.parquet(f"{tmp_path}/t"))


def test_two_stages_of_one_name():
    with pytest.raises(ValueError):
        Pipeline(None, "x", [Stage("a", (), None), Stage("a", (), None)])
