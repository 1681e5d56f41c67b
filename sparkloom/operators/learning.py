"""Operators of the learning loop: leaders and their members, gates, evidence, fidelity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.work import Tables

# What a session should do, any of the steps, and what it costs to leave it out.
FIDELITY = ((0.25, ("closeout",)), (0.15, ("bootstrap",)), (0.10, ("steps", "plan")), (0.10, ("partial",)))


def leaders(items: DataFrame, pairs: DataFrame, key: str, order: str) -> DataFrame:
    """key, leader: what going through items in order gives, where each joins the most similar leader so far or leads.

    pairs (a, b, cosine) has every pair above the threshold. An item leads if no earlier neighbour does; it
    is decided once all earlier neighbours are, so a round decides the first undecided of every
    chain at once. Rounds end when none is open; an item without neighbours is decided in the first one.
    """
    tables = Tables(items.sparkSession, "leaders")
    place = items.select(F.col(key).alias("k"), F.col(order).alias("o"))
    both = pairs.select("a", "b", "cosine").union(pairs.select("b", "a", "cosine"))
    near = both.join(place.select(F.col("k").alias("a"), F.col("o").alias("oa")), "a").join(place.select(F.col("k").alias("b"), F.col("o").alias("ob")), "b")
    earlier = tables.written(near.where("ob < oa").select("a", "b", "ob", "cosine"))  # b comes before a
    open_, decided, rounds = tables.written(place.select("k")), None, 0
    while open_.limit(1).count():
        state = open_.withColumn("leads", F.lit(None).cast("boolean"))
        known = state if decided is None else state.unionByName(decided)
        seen = earlier.join(open_.withColumnRenamed("k", "a"), "a").join(known.withColumnRenamed("k", "b"), "b")
        verdict = seen.groupBy("a").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("follows"), F.bool_or(F.col("leads").isNull()).alias("waits"))
        joined = open_.join(verdict.withColumnRenamed("a", "k"), "k", "left")
        follows, waits = F.coalesce("follows", F.lit(False)), F.coalesce("waits", F.lit(False))
        now = tables.written(joined.where(follows | ~waits).select("k", (~follows).alias("leads")))
        decided, rounds = now if decided is None else decided.unionByName(now), rounds + 1
        if rounds % 8 == 0:  # or a long chain's plan reads a table for each round
            decided = tables.written(decided)
        open_ = tables.written(open_.join(now, "k", "left_anti"))
    decided = open_.withColumn("leads", F.lit(True)) if decided is None else decided
    followed = earlier.join(decided.where("leads").select(F.col("k").alias("b")), "b", "left_semi").join(decided.where("not leads").select(F.col("k").alias("a")), "a", "left_semi")
    best = followed.groupBy("a").agg(F.max(F.struct("cosine", (-F.col("ob")).alias("no"), "b")).alias("m")).select(F.col("a").alias("k"), F.col("m.b").alias("leader"))
    return decided.join(best, "k", "left").select(F.col("k").alias(key), F.coalesce("leader", "k").alias("leader"))


def leaders_of_classes(items: DataFrame, members: DataFrame, pairs: DataFrame, key: str, order: str) -> DataFrame:
    """leaders() from classes of copies: members (key, rep) and pairs (a, b, cosine) of reps; an item without a class is alone.

    Of a class only the first item in order can lead, so the rounds go over first items; then each item takes the most
    similar leader before it, its own class's included.
    """
    tables = Tables(items.sparkSession, "leaders")
    all_ = tables.written(items.select(F.col(key).alias("k"), F.col(order).alias("o")).join(members.select(F.col(key).alias("k"), "rep"), "k", "left"))
    firsts = all_.where("rep is not null").groupBy("rep").agg(F.min("o").alias("o"), F.min_by("k", "o").alias("k"))
    led = tables.written(leaders(firsts.select("rep", "o"), pairs, "rep", "o").where("leader = rep").select("rep").join(firsts, "rep").select(F.col("rep").alias("by"), F.col("o").alias("ob"), F.col("k").alias("leader")))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("by"), "cosine").union(pairs.select("b", "a", "cosine"))
    near = both.join(led, "by").union(led.select("by", F.col("by").alias("rep"), F.lit(1.0), "ob", "leader"))
    ahead = all_.join(led.select("leader"), all_.k == F.col("leader"), "left_anti").join(near, "rep").where("ob < o")
    best = ahead.groupBy("k").agg(F.max(F.struct("cosine", (-F.col("ob")).alias("no"), "leader")).alias("m")).select("k", "m.leader")
    return all_.select("k").join(best, "k", "left").select(F.col("k").alias(key), F.coalesce("leader", "k").alias("leader"))


def fidelity(tools: Column) -> tuple[Column, Column]:
    """The score of a set of steps, 1 less what is missing costs, and the missing steps."""
    score, missing = F.lit(1.0), []
    for cost, steps in FIDELITY:
        absent = ~F.arrays_overlap(tools, F.array(*map(F.lit, steps)))
        score = score - F.when(absent, cost).otherwise(0.0)
        missing.append(F.when(absent, "|".join(steps[:2])))
    return F.round(F.greatest(score, F.lit(0.0)), 6), F.array_compact(F.array(*missing))


def gates(proposals: DataFrame) -> DataFrame:
    """Adds outcome and reason: the first gate that stops a proposal (duplicate, valid, credibility, seen, survival)."""
    reject = lambda cond, why: F.when(cond, F.struct(F.lit("reject").alias("outcome"), F.lit(why).alias("reason")))
    first = F.coalesce(
        reject(F.col("duplicate"), "duplicate"),
        reject(~F.col("valid"), "syntax"),
        reject(F.col("credibility") < 0.2, "credibility"),
        F.when(F.col("seen") < 5, F.struct(F.lit("trial").alias("outcome"), F.lit("seen too rarely").alias("reason"))),
        reject(F.col("survival") < 0.5, "survival"),
        F.struct(F.lit("pass").alias("outcome"), F.lit("").alias("reason")),
    )
    return proposals.withColumn("_g", first).select("*", "_g.outcome", "_g.reason").drop("_g")
