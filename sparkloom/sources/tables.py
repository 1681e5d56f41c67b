"""Readers of the tables, and projections of them to the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with sess (user and day), k (the number in props) and at (seconds since 1970)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "ts", "event_type", "value", "props",
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd")).alias("sess"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"),
    )


def outcomes(e: DataFrame) -> DataFrame:
    return e.where(F.col("event_type").isin("error", "purchase")).withColumn("passed", F.col("event_type") == "purchase")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (from_id, to_id, relation) over customers, orders, suppliers, nations and regions."""
    o, c, s, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "nation"))
    edge = lambda df, a, x, b, y, rel: df.select(F.concat(F.lit(a), F.col(x)).alias("from_id"), F.concat(F.lit(b), F.col(y)).alias("to_id"), F.lit(rel).alias("relation"))
    return (
        edge(o, "o:", "o_orderkey", "c:", "o_custkey", "uses")
        .union(edge(c, "c:", "c_custkey", "n:", "c_nationkey", "owns"))
        .union(edge(s, "s:", "s_suppkey", "n:", "s_nationkey", "owns"))
        .union(edge(n, "n:", "n_nationkey", "r:", "n_regionkey", "derived_from"))
    )
