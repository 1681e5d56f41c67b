"""Lookups over stores: tiers of candidates for requested names, in one join for all requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tiers(requests: DataFrame, request: str, units: DataFrame, keys: list[tuple[str, Column, Column]], order: list[Column], most: int) -> DataFrame:
    """Candidates of each request from the first tier that has any, at most so many, with their place.

    keys: (tier, what the request is looked up by, what a unit is known by). Every tier is an equi-join
    on the distinct requests; rows of all tiers meet in one window. order breaks ties in a tier.
    """
    asked = requests.select(request).where(F.col(request).isNotNull()).distinct()
    found = None
    for rank, (tier, wanted, known) in enumerate(keys):
        part = asked.withColumn("_k", wanted).join(units.withColumn("_k", known), "_k").drop("_k").withColumns({"tier": F.lit(tier), "_rank": F.lit(rank)})
        found = part if found is None else found.unionByName(part)
    best = W.partitionBy(request)
    first = found.withColumn("_least", F.min("_rank").over(best)).where("_rank = _least")
    place = F.row_number().over(best.orderBy(*order))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("_rank", "_least")


def cascade(requests: DataFrame, request: str, units: DataFrame, keys: list[tuple[str, Column, Column]], id_: str, order: list[Column], most: int) -> DataFrame:
    """As tiers(), but later tiers add to earlier ones: each unit once, in its first tier, at most so many."""
    asked = requests.select(request).where(F.col(request).isNotNull()).distinct()
    found = None
    for rank, (tier, wanted, known) in enumerate(keys):
        part = asked.withColumn("_k", wanted).join(units.withColumn("_k", known), "_k").drop("_k").withColumns({"tier": F.lit(tier), "_rank": F.lit(rank)})
        found = part if found is None else found.unionByName(part)
    once = found.withColumn("_n", F.row_number().over(W.partitionBy(request, id_).orderBy("_rank"))).where("_n = 1")
    place = F.row_number().over(W.partitionBy(request).orderBy("_rank", *order))
    return once.withColumn("place", place).where(F.col("place") <= most).drop("_rank", "_n")
