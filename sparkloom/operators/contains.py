"""Joins by a part of a text: every needle meets the texts that hold it, or end with it, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.work import Tables

#: Characters of the pieces by which texts and needles meet; shorter needles are their own piece.
PIECE = 3
#: Characters of the longest needle that held() looks up whole.
WHOLE = 16


def pieces(text: Column, size: int) -> Column:
    """The distinct runs of so many characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1)))


def contained(needles: DataFrame, needle: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """needle, key of each distinct needle and each text that holds it, in any case; as LIKE with a per cent sign on both sides.

    Keys are unique. Null and empty needles fit nothing, null texts hold nothing. Texts give only pieces that some needle
    has. A needle is looked up by the one of its pieces that the fewest texts have, and not at all if a piece is nowhere;
    what is found is compared. A piece that very many texts have is looked up for needles that have no rarer one.
    """
    work = Tables(texts.sparkSession, "contained")
    asked = work.written(needles.select(F.col(needle).alias("needle"), F.lower(needle).alias("low")).where("low <> ''").distinct())
    size = F.least(F.length("low"), F.lit(PIECE))
    wanted = asked.select("low").distinct().withColumn("size", size)
    own = F.when(F.col("size") == 1, pieces(F.col("low"), 1)).when(F.col("size") == 2, pieces(F.col("low"), 2)).otherwise(pieces(F.col("low"), PIECE))
    wanted = work.written(wanted.select("low", "size", F.explode(own).alias("piece")))
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # three at most
    if not sizes:
        return asked.join(texts.select(F.col(key).alias("key")), F.lit(False)).select(F.col("needle").alias(needle), F.col("key").alias(key))
    low = texts.select(F.col(key).alias("key"), F.lower(text).alias("t"))
    there = low.select("key", F.explode(F.array_distinct(F.flatten(F.array(*[pieces(F.col("t"), n) for n in sizes])))).alias("piece"))
    there = work.written(there.join(wanted.select("piece").distinct(), "piece", "left_semi"))
    counts = there.groupBy("piece").agg(F.count("*").alias("n"))
    rare = wanted.join(counts, "piece", "left").groupBy("low").agg(F.min_by("piece", F.coalesce("n", F.lit(0))).alias("piece"), F.count_if(F.col("n").isNull()).alias("nowhere"))
    found = rare.where("nowhere = 0").select("low", "piece").join(there, "piece").select("low", "key")
    checked = found.join(low, "key").where(F.contains("t", F.col("low"))).select("low", "key")
    return checked.join(asked, "low").select(F.col("needle").alias(needle), F.col("key").alias(key))


def held(needles: DataFrame, needle: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """needle: each distinct needle that some text holds, in any case; contained() without the texts.

    Needles of up to WHOLE characters are met by the beginnings of the runs of that length at every place of the texts:
    rows grow with the texts, a row a place and length that occurs, and only needles are kept. Longer ones go by contained().
    """
    work = Tables(texts.sparkSession, "held")
    asked = work.written(needles.select(F.col(needle).alias("needle"), F.lower(needle).alias("low")).where("low <> ''").distinct())
    lengths = sorted(r[0] for r in asked.select(F.length("low").alias("n")).where(F.col("n") <= WHOLE).distinct().collect())  # WHOLE at most
    found = contained(asked.where(F.length("low") > WHOLE), "low", texts, key, text).select("low")
    if lengths:
        places = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{1,{lengths[-1]}}}))"), F.lit(1)))).alias("run"))
        runs = places.select(F.explode(F.array_compact(F.array(*[F.when(F.length("run") >= n, F.left("run", F.lit(n))) for n in lengths]))).alias("low"))
        found = found.union(runs.join(work.written(asked.select("low").distinct()), "low", "left_semi"))
    return asked.join(found.distinct(), "low", "left_semi").select(F.col("needle").alias(needle))


def ending(suffixes: DataFrame, suffix: str, names: DataFrame, key: str, name: str) -> DataFrame:
    """suffix, key of each distinct suffix and each name that ends with it, in any case.

    A name meets the suffixes of each length that occurs, by its end of that length: rows grow with the number
    of lengths, at most the longest suffix. Null and empty suffixes fit nothing.
    """
    asked = suffixes.select(F.col(suffix).alias("suffix"), F.lower(suffix).alias("low")).where("low <> ''").distinct()
    lengths = asked.agg(F.collect_set(F.length("low")).alias("lengths"))  # a single row
    n = names.select(F.col(key).alias("key"), F.lower(name).alias("t")).crossJoin(F.broadcast(lengths))
    ends = n.select("key", "t", F.explode("lengths").alias("n")).where(F.length("t") >= F.col("n")).select("key", F.right("t", F.col("n")).alias("low"))
    return ends.join(asked, "low").select(F.col("suffix").alias(suffix), F.col("key").alias(key))
