"""Event-time operators: session keys, delivery at most once, offers and confirmations.

Each is written over a DataFrame; those without a window function also run on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def session_key(events: DataFrame, by: str = "user_id", at: str = "at", trailing: int = 7200) -> DataFrame:
    """Adds session_minute: the minute of the earliest event in the trailing two hours."""
    first = F.min(at).over(W.partitionBy(by).orderBy(at).rangeBetween(-trailing, 0))
    return events.withColumn("session_minute", F.floor(first / 60))


def deliver_once(pushes: DataFrame, keys: list[str], at: str, session: str, most: int) -> DataFrame:
    """The first push of each key, and of those the first so many of a session."""
    w = W.partitionBy(*keys).orderBy(at, "event_id")
    once = pushes.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    cap = W.partitionBy(session).orderBy(at, "event_id")
    return once.withColumn("_n", F.row_number().over(cap)).where(F.col("_n") <= most).drop("_n")


def confirm_offers(offers: DataFrame, seen: DataFrame, keys: list[str], within: int = 86400) -> DataFrame:
    """Offers (keys, offer_id, offered) with the first sight (keys, seen_at) within so many seconds, or null.

    Both sides run through one window over their keys, so a hot key makes no pairs. A null key confirms nothing.
    """
    both = offers.select(*keys, "offer_id", F.col("offered").alias("_at"), F.lit(None).cast("long").alias("_seen")).union(
        seen.select(*keys, F.lit(None), F.col("seen_at"), F.col("seen_at"))
    )
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    first = F.min("_seen").over(W.partitionBy(*keys).orderBy("_at").rangeBetween(0, within))
    return both.withColumn("seen_at", F.when(known, first)).where("offer_id is not null").select("offer_id", "seen_at")


def heartbeats(events: DataFrame, bar: float = 100.0) -> DataFrame:
    """hook, fired, matched, last_at: counters that also run as a streaming aggregation in update mode."""
    return events.groupBy(F.col("event_type").alias("hook")).agg(F.count("*").alias("fired"), F.count_if(F.col("value") > bar).alias("matched"), F.max("at").alias("last_at"))
