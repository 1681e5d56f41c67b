"""Scores of texts for a query's words that need no index, and what is shown of the results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.prose import RECALL_STOP, identifiers
from sparkloom.operators.index import words


def recall_terms(topic: str) -> list[str]:
    """The words of a topic that tell: three bytes or more and not common."""
    return [t for t in re.split(r"[^\w]+", topic.lower()) if len(t.encode()) >= 3 and t not in RECALL_STOP]


def recall_score(text: Column, phrase: str, terms: list[str]) -> Column:
    """The phrase: terms x 10; one term: its hit; several: the number of them found, if two or more."""
    hits = sum(F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms)
    return F.when(F.contains(F.lower(text), F.lit(phrase)), F.lit(10 * max(1, len(terms)))).when(F.lit(len(terms) == 1) | (hits >= 2), hits).otherwise(0)


def hint_score(text: Column, hint: list[str]) -> Column:
    """How many different words of a hint a text has, as whole words or, from six bytes on, as starts of words."""
    own = F.array_distinct(words(text))

    def hit(t: str) -> Column:
        return (F.exists(own, lambda x: x.startswith(t)) if len(t.encode()) >= 6 else F.array_contains(own, t)).cast("int")

    return sum((hit(t) for t in hint), F.lit(0))


def expand_threshold(hint: list[str]) -> int:
    """The score from which an entry is shown whole: two words of a hint of three or more."""
    return 2 if len(hint) >= 3 else 1


def best_trap(errors: DataFrame, traps: DataFrame, most_df: int = 3, least_score: int = 2, least_rare: int = 3, lone: int = 9) -> DataFrame:
    """id, trap, ids, rare, score: for each error (id, text) the trap (id, description) with the best distinctive evidence.

    A word is distinctive if at most most_df traps have it. A trap qualifies by a distinctive identifier with
    another distinctive word or of lone characters and more, or by least_rare distinctive words and least_score
    common ones. The most identifiers, then distinctive words, then common words win; ties go to the last trap. Common words meet in an equi-join whose right side is
    the traps' words; words of six bytes and more also meet words that they begin.
    """
    w = traps.select(F.col("id").alias("trap"), F.explode(F.array_distinct(words(F.col("description")))).alias("word"))
    asked = errors.select("id", F.explode(F.array_distinct(words(F.col("text")))).alias("token")).where(F.octet_length("token") >= 4)
    tokens = asked.select("token").distinct()
    whole = tokens.join(w, F.col("token") == F.col("word"))
    start = tokens.where(F.octet_length("token") >= 6).withColumn("_s", F.substring("token", 1, 6)).join(w.withColumn("_s", F.substring("word", 1, 6)), "_s").where(F.col("word").startswith(F.col("token")))
    hit = whole.select("token", "trap").union(start.select("token", "trap")).distinct()
    rare = hit.groupBy("token").agg((F.count("*") <= most_df).alias("distinctive"))
    names = errors.select("id", F.explode(identifiers(F.col("text"))).alias("token")).withColumn("named", F.lit(True))
    both = asked.join(hit, "token").join(rare, "token").join(names, ["id", "token"], "left")
    found = F.col("distinctive")
    named = found & F.coalesce("named", F.lit(False))
    g = both.groupBy("id", "trap").agg(F.count_if(named).alias("ids"), F.count_if(found).alias("rare"), F.count("*").alias("score"), F.bool_or(named & (F.length("token") >= lone)).alias("long"))
    enough = (F.col("long") | ((F.col("ids") >= 1) & (F.col("rare") >= 2))) | ((F.col("rare") >= least_rare) & (F.col("score") >= least_score))
    best = g.where(enough).groupBy("id").agg(F.max(F.struct("ids", "rare", "score", "trap")).alias("m"))
    return best.select("id", "m.trap", "m.ids", "m.rare", "m.score")


def budgeted(rows: DataFrame, section: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Adds place, used, listed: rows of a section in order, listed while their running cost is within the budget."""
    w = W.partitionBy(section).orderBy(*order)
    used = F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"place": F.row_number().over(w).cast("long"), "used": used, "listed": used <= budget})
