"""Mixes sources to target weights by entropy balancing: DataFrame operations only.

Of all rates that give each source its target number of words, those nearest to one (in relative
entropy, none above three) are exp(dual * size), cut off at three. The dual of a source solves a
convex problem; all sources' duals are found together by Newton steps, each of which is one
aggregation over cells (source, size, number of documents). Rates are then rounded into copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Work

#: Times that a source, and a document, may be taken at most.
MOST = 3.0
#: A source's words may miss its target by so many, or by this share, when the steps end; rounding follows.
CLOSE, CLOSE_SHARE = 1e-3, 1e-9
#: Newton steps in one job, and jobs at most: a step that leaves its bracket halves it, so 200 steps reach the last bit.
STEPS, MOST_JOBS = 4, 50
#: Cells of more documents than this, and than 1 in so many of all, are ranked in parts: so at most HOT_CELLS cells are broadcast.
HOT_ROWS, HOT_CELLS = 1_000, 10_000

_KEY = ["src", "no_src"]
_CELL = [*_KEY, "size"]


def _exact(x: Column) -> Column:
    """Sums of decimals don't depend on their order, so reruns agree to the last digit."""
    return x.cast("decimal(28,9)")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to the rows (src, no_src, source_size), one for each source.

    Weights are 1, 2, 3, repeating, by code point, null last. Targets are weight * level, at most
    MOST times the source's size; the level is such that they sum to all sizes. Sources are cut off
    in the order of size to weight; each cut raises the level of the rest as long as it is due, so
    the level is the highest of those that running sums give. Windows run over the list of sources, not over documents.
    """
    weight = ((F.row_number().over(Window.orderBy("no_src", "src")) - 1) % 3 + 1).cast("long")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "no_src", "src")
    before, after, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    limit = MOST * F.col("source_size")
    level = (F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    out = sources.withColumn("weight", weight).withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return out.withColumn("target", F.least(limit, F.col("level") * F.col("weight"))).drop("level")


def _rate() -> Column:
    return F.least(F.lit(MOST), F.exp(F.col("dual") * F.col("size") / F.col("mean")))


def newton_step(cells: DataFrame, duals: DataFrame) -> DataFrame:
    """One step of every source: words at the present dual and their slope, from all cells, then the next dual in its bracket."""
    z = F.col("size") / F.col("mean")
    words = _exact(F.sum(_exact(F.col("n") * F.col("size") * _rate()))).cast("double")
    slope = F.sum(_exact(F.when(F.col("dual") * z < math.log(MOST), F.col("n") * F.col("size") * z * _rate()).otherwise(0.0))).cast("double")
    keep = [F.first(c).alias(c) for c in ("target", "mean", "dual", "low", "high")]
    found = cells.join(duals, _KEY).groupBy(*_KEY).agg(*keep, words.alias("words"), slope.alias("slope"))
    miss = F.col("words") - F.col("target")
    found = found.withColumn("done", F.abs(miss) <= F.greatest(F.lit(CLOSE), CLOSE_SHARE * F.col("target")))
    found = found.withColumn("low", F.when(miss < 0, F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(miss > 0, F.col("dual")).otherwise(F.col("high")))
    newton = F.col("dual") - miss / F.when(F.col("slope") > 0, F.col("slope"))
    inside = (newton > F.col("low")) & (newton < F.col("high"))
    step = F.when(F.col("done"), F.col("dual")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
    return found.withColumn("dual", step).select(*_KEY, "target", "mean", "dual", "low", "high", "done")


def balance(work: Work, cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, no_src, mean, dual) of every source with words."""
    cells = cells.where("size > 0")
    least = cells.groupBy(*_KEY).agg(F.min("size").alias("least"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    # as no rate is beyond that of the shortest text, the dual lies between 0 and this
    edge = F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least")
    none = F.lit(0.0)
    duals = sources.where("source_size > 0").join(least, _KEY).select(*_KEY, "target", "mean", none.alias("dual"), F.least(none, edge).alias("low"), F.greatest(none, edge).alias("high"), F.lit(False).alias("done"))
    for i in range(MOST_JOBS):
        for _ in range(STEPS):
            duals = newton_step(cells, duals)
        duals = work.table(duals, f"duals-{i}")
        if not duals.where("not done").limit(1).count():
            break
    return duals.select(*_KEY, "mean", "dual")


def rounded(cells: DataFrame) -> DataFrame:
    """Adds copies, the whole number for all documents of a cell, to cells with n, rate and target.

    Running sums of the rates in the order of size are rounded, so a source's words miss its target by some two
    of its longest documents at most. What it misses is then made up from one cell of each power of two,
    from long to short. A source has as many cells as there are different sizes of its documents.
    """
    order = Window.partitionBy(*_KEY).orderBy(F.desc("size"))
    upto = F.sum(F.when(F.col("size") > 0, _exact(F.col("n") * F.col("rate"))).otherwise(_exact(F.lit(0)))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("upto", F.floor(upto + F.lit("0.5").cast("decimal(2,1)")).cast("long"))
    cells = cells.withColumn("copies", F.when(F.col("size") > 0, F.col("upto") - F.coalesce(F.lag("upto").over(order), F.lit(0))).otherwise(F.col("n"))).drop("upto")
    room, class_ = (MOST * F.col("n") - F.col("copies")).cast("long"), F.floor(F.log2("size"))
    largest = lambda x: F.max(F.struct(x.alias("room"), F.col("size").alias("size")))
    classes = cells.where("size > 0").groupBy(*_KEY, class_.alias("class")).agg(
        largest(room).alias("more"), largest(F.col("copies")).alias("fewer"), F.sum(F.col("copies") * F.col("size")).alias("words"), F.first("target").alias("target")
    )
    steps = classes.groupBy(*_KEY).agg((F.first("target") - F.sum("words")).alias("miss"), F.reverse(F.array_sort(F.collect_list(F.struct("class", "more", "fewer")))).alias("classes"))

    def take(done: Column, x: Column) -> Column:
        cell = F.when(F.col("miss") >= 0, x.more).otherwise(x.fewer)
        n = F.least(F.floor(done.rest / cell.size), cell.room).cast("long")
        move = F.struct(cell.size.alias("size"), F.when(F.col("miss") >= 0, n).otherwise(-n).alias("by"))
        return F.struct((done.rest - n * cell.size).alias("rest"), F.concat(done.moves, F.array(move)).alias("moves"))

    start = F.struct(F.abs("miss").alias("rest"), F.expr("cast(array() as array<struct<size: bigint, by: bigint>>)").alias("moves"))
    moves = steps.select(*_KEY, F.explode(F.aggregate("classes", start, take).moves).alias("move")).select(*_KEY, "move.*")
    return cells.join(moves, _CELL, "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by")


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate of every row of docs.

    size is the number of words in the text (null: 0), taken is copies * size. A source's words miss its
    target by about the size of its short documents, as far as those have room; copies are 3 at most. A text
    without words has rate 1 and one copy. Null sources are one source, the last. Which documents of
    equal source and size get the odd copies is decided by a hash of doc_id and the seed, so rows with
    equal doc_id, source and size may differ only as the copies among them do. An empty table
    gives an empty one. Other columns are not read.

    Documents are shuffled once, as (id, source, size); cells of very many equal sizes are ranked in parts.
    """
    work = Work(docs.sparkSession, "mix")
    source = F.coalesce("source", F.lit(""))
    sized = docs.select("doc_id", source.alias("src"), F.col("source").isNull().alias("no_src"), word_count(F.col("text")).alias("size"))
    sized = work.table(sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "sized")
    cells = work.table(sized.groupBy(*_CELL).agg(F.count("*").alias("n")), "cells")
    sources = work.table(targets(cells.groupBy(*_KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "sources")
    duals = balance(work, cells, sources)
    known = cells.join(sources, _KEY).join(duals, _KEY, "left").withColumn("rate", F.when(F.col("size") > 0, _rate()).otherwise(1.0))
    known = work.table(rounded(known.select(*_CELL, "n", "source_size", "target", "rate")), "known")
    known = known.select(*_CELL, "n", "source_size", "target", "rate", F.expr("copies div n").alias("base"), (F.col("copies") % F.col("n")).alias("extra"))

    everything = known.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, everything // HOT_CELLS)
    hot = known.where(F.col("n") > limit).select(*_CELL, F.ceil(F.col("n") / limit).alias("parts"))
    dealt = sized.join(F.broadcast(hot), _CELL, "left").withColumn("part", F.coalesce(F.pmod("h", F.col("parts")), F.lit(0)))
    places = dealt.where("parts is not null").groupBy(*_CELL, "part").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy(*_CELL).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("start", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    quotas = known.where(F.col("n") > limit).join(places, _CELL).unionByName(known.where(F.col("n") <= limit).withColumns({"part": F.lit(0).cast("long"), "start": F.lit(0).cast("long")}))
    place = F.row_number().over(Window.partitionBy(*_CELL, "part").orderBy("h", "doc_id"))
    ranked = dealt.drop("parts").withColumn("place", place).join(quotas, [*_CELL, "part"])
    copies = F.col("base") + (F.col("start") + F.col("place") <= F.col("extra")).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate")
