"""Operators over code units: facets, inferred edges, call resolution, change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lines of a unit's body that name types it uses.
USE_LINES = ("fields:", "methods:", "sig:")


def type_tokens(line: Column) -> Column:
    """Runs of ASCII letters, digits and underscores that begin with a capital."""
    return F.filter(F.regexp_extract_all(line, F.lit("[A-Za-z0-9_]+"), 0), lambda t: t.rlike("^[A-Z]"))


def nodes(units: DataFrame) -> DataFrame:
    """id, name: the smallest id of each name, which a mention of the name stands for."""
    return units.groupBy("name").agg(F.min("id").alias("to_id"))


def lines(units: DataFrame) -> DataFrame:
    return units.select("id", "name", F.explode(F.split("body", "\n")).alias("line"))


def methods(units: DataFrame) -> DataFrame:
    """id, root, method: the names of a unit's methods lines."""
    of = F.regexp_extract(F.col("line"), r"^methods:\s*(.*)$", 1)
    rows = units.select("id", "root", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").startswith("methods:"))
    return rows.select("id", "root", F.explode(F.split(of, r"\s*\|\s*")).alias("method")).where("method <> ''")


def infer_edges(units: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, relation: traits that a unit implements, types it uses, and members that derive from it.

    targets are the units that names stand for, if not the same ones. Each edge once.
    """
    by_name, rows = nodes(units if targets is None else targets), lines(units)
    traits = F.explode(F.transform(F.split(F.substring("line", 6, 1_000_000), ","), lambda t: F.trim(t)))
    implements = rows.where(F.col("line").startswith("impl:")).select("id", traits.alias("t"))
    used = F.col("line").startswith(USE_LINES[0]) | F.col("line").startswith(USE_LINES[1]) | F.col("line").startswith(USE_LINES[2]) | F.ltrim("line").startswith(F.concat("name", F.lit("::")))
    uses = rows.where(used).select("id", "name", F.explode(type_tokens(F.col("line"))).alias("t")).where("t <> name")
    resolved = lambda df, relation: df.join(by_name, df.t == by_name.name).select(F.col("id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), F.lit(relation).alias("relation"))
    derived = methods(units).select(F.concat(F.col("id").cast("string"), F.lit("::method:"), F.col("method")).alias("from_id"), F.col("id").cast("string").alias("to_id"), F.lit("derived_from").alias("relation"))
    return resolved(implements, "implements").union(resolved(uses.drop("name"), "uses")).union(derived).distinct()


def mentioning(units: DataFrame, changed: DataFrame) -> DataFrame:
    """Units outside of the changed ones whose text names one of them."""
    names = changed.select(F.col("name").alias("token")).distinct()
    words = units.select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[A-Za-z0-9_]+"), 0))).alias("token"))
    return units.join(words.join(names, "token", "left_semi").select("id").distinct(), "id", "left_semi").join(changed.select("id"), "id", "left_anti")


def attach(parts: DataFrame, types: DataFrame) -> DataFrame:
    """part, unit: each part (part, name, module) with the type (id, name, module) of its name that shares most leading segments; ties: the last id."""
    # a type stands at each beginning of its path, the last id only, so a part meets one row for each of its own beginnings
    at = lambda df: df.withColumn("_s", F.coalesce(F.split("module", "::"), F.array().cast("array<string>"))).withColumn("overlap", F.explode(F.sequence(F.lit(0), F.size("_s")))).withColumn("_path", F.slice("_s", F.lit(1), F.col("overlap")))
    last = at(types.select("id", "name", "module")).groupBy("name", "overlap", "_path").agg(F.max("id").alias("unit"))
    met = at(parts.select("part", "name", "module")).join(last, ["name", "overlap", "_path"])
    return met.groupBy("part").agg(F.max(F.struct("overlap", "unit")).alias("m")).select("part", F.col("m.unit").alias("unit"), F.col("m.overlap").alias("overlap"))


def split_top_level(text: Column, sep: str = ",") -> Column:
    """Parts between separators that aren't inside brackets, trimmed; empty parts are left out."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("parts"))

    def step(s, c):
        depth = s["depth"] + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)
        cut = (c == sep) & (s["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["now"], c)).alias("now"), F.when(cut, F.concat(s["parts"], F.array(s["now"]))).otherwise(s["parts"]).alias("parts"))

    whole = F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(s["parts"], F.array(s["now"])))
    return F.filter(F.transform(whole, lambda p: F.trim(p)), lambda p: p != "")


def facets(units: DataFrame) -> DataFrame:
    """id, facet, key, value: fields, methods, traits and signature of each unit; prose is left out."""
    head, rest = F.regexp_extract("line", r"^([a-z]+):", 1), F.trim(F.regexp_replace("line", r"^[a-z]+:", ""))
    parts = F.when(head == "methods", F.split(rest, r"\s*\|\s*")).when(head == "sig", F.array(rest)).otherwise(split_top_level(rest))
    # dealt out by id first: equal facets have one id, so nothing else is shuffled, and no task holds a whole file's facets
    rows = units.select("id", "body").repartition("id").select("id", F.explode(F.split("body", "\n")).alias("line")).where(head.isin("fields", "methods", "impl", "sig"))
    rows = rows.select("id", head.alias("facet"), F.explode(parts).alias("part")).where("part <> ''")
    return rows.select("id", "facet", F.trim(F.regexp_extract("part", r"^([^:]*)", 1)).alias("key"), F.trim(F.regexp_replace("part", r"^[^:]*:?", "")).alias("value")).distinct()


def facet_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, facet, key, sign: + what is new, - what went, ~ what has another value."""
    key = ["id", "facet", "key"]
    one = lambda df, name: df.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias(name))
    both = one(before, "b").join(one(after, "a"), key, "full")
    sign = F.when(F.col("b").isNull(), "+").when(F.col("a").isNull(), "-").when(F.col("a") != F.col("b"), "~")
    return both.select(*key, sign.alias("sign")).where("sign is not null")


def check_ladder(now: DataFrame, before: DataFrame, taken_at: int, racy: int = 3) -> DataFrame:
    """path, state of stamped files (path, len, mtime, hash): hashes count only where stamps differ or are too fresh to trust."""
    b = before.select("path", F.col("len").alias("bl"), F.col("mtime").alias("bm"), F.col("hash").alias("bh"))
    both = now.join(b, "path", "full")
    same = (F.col("len") == F.col("bl")) & (F.col("mtime") == F.col("bm"))
    fresh = F.col("bm") >= taken_at - racy
    state = F.when(F.col("bl").isNull(), "new").when(F.col("len").isNull(), "gone").when(same & ~fresh, "same").when(F.col("hash") == F.col("bh"), F.when(same, "racy").otherwise("touched")).otherwise("changed")
    return both.select("path", state.alias("state"))


def drift_notes(entries: DataFrame, references: Column, names: DataFrame, journal: DataFrame, most: int = 3) -> DataFrame:
    """id, name, at, change, place: names in entries (id, at) whose last change is later than the entry; at most three an entry, by name.

    names: (unit, name) that stand for a unit; journal: (id, unit, at, change).
    """
    last = journal.groupBy("unit").agg(F.max(F.struct(F.col("id").alias("i"), F.col("at").alias("changed_at"), "change")).alias("l")).select("unit", "l.changed_at", "l.change")
    of_name = last.join(names, "unit").groupBy("name").agg(F.max(F.struct("changed_at", "change")).alias("m")).select("name", "m.*")
    refs = entries.select("id", "at", F.explode(references).alias("name"))
    moved = refs.join(of_name, "name").where("changed_at > at")
    place = F.row_number().over(W.partitionBy("id").orderBy("name"))
    return moved.select("id", "name", "changed_at", "change", place.cast("long").alias("place")).where(F.col("place") <= most)
