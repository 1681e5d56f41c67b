"""Readers of foreign files: source trees, transcripts, JSON stores, manifests; each is lazy and prunes before it parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of build output and tools that a source tree's walk leaves out.
PRUNED = ("target", "node_modules", ".git", "build", "dist", "__pycache__", ".venv", "vendor")


def kept_path(path: Column, ignored: list[str] | None = None) -> Column:
    """True for files outside of pruned folders that no pattern of an ignore list fits."""
    out = ~path.rlike("(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/")
    for pattern in ignored or ():
        if pattern and not pattern.startswith("#"):
            body = pattern.strip("/").replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")
            out = out & ~path.rlike(("(^|/)" if not pattern.startswith("/") else "^") + body + "(/|$)")
    return out


def source_lines(spark: SparkSession, folder: str, ignored: list[str] | None = None) -> DataFrame:
    """path, line of all kept text files below a folder; the path filter runs on file metadata, before lines are made."""
    path = F.regexp_extract(F.col("_metadata.file_path"), r"/tree/(.*)$", 1)
    rows = spark.read.option("recursiveFileLookup", "true").text(folder).select(path.alias("path"), F.col("value").alias("line"))
    return rows.where(kept_path(F.col("path"), ignored))


def stamps(spark: SparkSession, folder: str) -> DataFrame:
    """path, len, mtime of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"/tree/(.*)$", 1).alias("path"), F.col("length").alias("len"), F.unix_micros("modificationTime").alias("mtime"))


def marked_lines(lines: DataFrame, needle: str, schema: str) -> DataFrame:
    """The parsed fields of JSON lines that hold needle; others are dropped as text, before they are parsed."""
    return lines.where(F.contains("value", F.lit(needle))).select(F.from_json("value", schema).alias("j")).where("j is not null").select("j.*")


def recent_lines(lines: DataFrame, field: str, since: str, schema: str) -> DataFrame:
    """The parsed fields of JSON lines whose timestamp field is since (as text) or later; the text of the time decides first."""
    at = F.regexp_extract("value", f'"{field}":"([^"]*)"', 1)
    return lines.where((at >= since) & (at != "")).select(F.from_json("value", schema).alias("j")).select("j.*")


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """graph, id, community of community graph files: objects with a list of nodes."""
    schema = "graph string, nodes array<struct<id:bigint,community:bigint>>, links array<struct<source:bigint,target:bigint>>"
    return spark.read.schema(schema).json(path).select("graph", F.explode("nodes").alias("n")).select("graph", "n.id", "n.community")


def manifest_targets(spark: SparkSession, path: str) -> DataFrame:
    """name, target, ignored of a manifest: its targets, each with whether the ignore list names it."""
    m = spark.read.schema("name string, targets array<string>, ignore array<string>").json(path)
    return m.select("name", F.explode("targets").alias("target"), "ignore").select("name", "target", F.array_contains("ignore", F.col("target")).alias("ignored"))


def merged(versions: list[DataFrame]) -> DataFrame:
    """Rows of several versions of a table; columns that a version lacks are null."""
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out
