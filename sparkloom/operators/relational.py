"""Joins, change capture and ordered analytics that have no single built-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def net_changes(journal: DataFrame, unit: str, order: list[str], change: str = "change") -> DataFrame:
    """unit, net: what a journal comes to for each unit, from its first and last change; units that came and went are left out."""
    at = F.struct(*order)
    ends = journal.groupBy(unit).agg(F.min_by(change, at).alias("first"), F.max_by(change, at).alias("last"), F.count("*").alias("n"))
    net = F.when((F.col("first") == "added") & (F.col("last") == "removed"), None).when(F.col("first") == "added", "added").when((F.col("first") == "removed") & (F.col("last") == "added"), "changed").when(F.col("last") == "removed", "removed").otherwise("changed")
    return ends.select(unit, net.alias("net"), "n").where("net is not null")


def diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: added, removed or changed; equal rows are left out."""
    b, a = before.select(key, F.col(content).alias("b")), after.select(key, F.col(content).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")


def unique_match(calls: DataFrame, targets: DataFrame, name: str, scope: str) -> DataFrame:
    """Calls with their only target: the one of that name overall, else the only one in the call's scope.

    targets are reduced to one row for each name and scope before the join, so an ambiguous name
    never multiplies calls.
    """
    per = targets.groupBy(name).agg(F.count("*").alias("n"), F.min("target").alias("only"))
    own = targets.groupBy(name, scope).agg(F.count("*").alias("n_own"), F.min("target").alias("only_own"))
    joined = calls.join(per, name).join(own, [name, scope], "left")
    pick = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_own") == 1, F.col("only_own"))
    return joined.select(*calls.columns, pick.alias("target")).where("target is not null")


def merge_intervals(rows: DataFrame, key: str, start: str, end: str, most: int = 1_000_000) -> DataFrame:
    """key, start, end of touching or overlapping intervals joined together.

    A task takes about most rows, whatever their number, unless one key has more: more rows are more tasks.
    """
    n = rows.count()
    if n > most:
        rows = rows.repartition(max(-(-n // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
    w = W.partitionBy(key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(seen.isNull() | (F.col(start) > seen + 1), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_island", island).groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")


def trend(now: Column, before: Column, band: float = 0.005) -> Column:
    return F.when(before.isNull() | now.isNull(), "new").when(F.abs(now - before) <= band, "flat").when(now > before, "up").otherwise("down")


def link_halves(halves: DataFrame) -> DataFrame:
    """key, provider, n_consumers, state: both sides of a boundary by key; the first provider wins, orphans stay."""
    one = halves.groupBy("key").agg(F.min(F.when(F.col("side") == "provide", F.col("id"))).alias("provider"), F.count_if(F.col("side") == "consume").alias("n_consumers"))
    state = F.when(F.col("provider").isNull(), "no provider").when(F.col("n_consumers") == 0, "no consumer").otherwise("linked")
    return one.select("key", "provider", "n_consumers", state.alias("state"))
