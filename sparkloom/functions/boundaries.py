"""Where programs meet across languages: routes, calls and exported names in lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules (pattern, group of the method or none, group of the path, side), tried in order.
RULES: tuple[tuple[str, int | None, int, str], ...] = (
    (r"""@\w+\.(get|post|put|patch|delete|head|options|websocket)\s*\(\s*["']([^"']+)["']""", 1, 2, "provide"),
    (r"""@\w+\.route\s*\(\s*["']([^"']+)["']""", None, 1, "provide"),
    (r"""\.route\s*\(\s*"([^"]+)"\s*,\s*(get|post|put|patch|delete)""", 2, 1, "provide"),
    (r"""#\[(get|post|put|patch|delete)\s*\(\s*"([^"]+)"\s*\)\]""", 1, 2, "provide"),
    (r"""\b(?:app|router|server|mux|api_router)\.(get|post|put|patch|delete|all|use)\s*\(\s*["'`]([^"'`]+)["'`]""", 1, 2, "provide"),
    (r"""HandleFunc\s*\(\s*"([^"]+)\"""", None, 1, "provide"),
    (r"""@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?"([^"]+)\"""", 1, 2, "provide"),
    (r"""\[Http(Get|Post|Put|Patch|Delete)\s*\(\s*"([^"]+)"\s*\)\]""", 1, 2, "provide"),
    (r"""\bfetch\s*\(\s*["'`]([^"'`]+)["'`]""", None, 1, "consume"),
    (r"""\b(?:axios|http|client|api)\.(get|post|put|patch|delete)\s*\(\s*["'`]([^"'`]+)["'`]""", 1, 2, "consume"),
    (r"""\brequests\.(get|post|put|patch|delete)\s*\(\s*["']([^"']+)["']""", 1, 2, "consume"),
    (r"""\bnew WebSocket\s*\(\s*["'`]([^"'`]+)["'`]""", None, 1, "consume"),
)
EXPORT = r"""extern\s+"C"\s+fn\s+(\w+)"""
IMPORT = r"""import\s*\{([^}]+)\}\s*from\s*["'`]([^"'`]*(?:wasm|_bg|ffi)[^"'`]*)["'`]"""


def route_key(url: Column) -> Column:
    """The path without scheme, host and query; lower-cased, with * for segments that are parameters."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^[^?#]*?://[^/]*$", "/"), r"^[^?#]*?://[^/]*/", "/")
    segments = F.filter(F.split(s, "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda x: F.when(x.rlike(r"[{<$*+]|^:"), "*").otherwise(F.lower(x))), "/"))


def name_key(name: Column) -> Column:
    """A function's name as either side of a binding may spell it."""
    return F.concat(F.lit("ffi:"), F.lower(F.replace(name, F.lit("_"), F.lit(""))))


def halves(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with kind, side, method, raw, key: each half of a boundary that a line holds; the first route rule that fits counts."""
    rule = F.lit(None)
    for pattern, method, path, side in reversed(RULES):
        found = F.struct(
            F.lit("http").alias("kind"), F.lit(side).alias("side"),
            (F.lower(F.regexp_extract(text, pattern, method)) if method else F.lit("any")).alias("method"),
            F.regexp_extract(text, pattern, path).alias("raw"),
        )
        rule = F.when(F.col(text).rlike(pattern), found).otherwise(rule)
    blank = F.lit("call")
    export = F.when(F.col(text).rlike(EXPORT), F.struct(F.lit("ffi").alias("kind"), F.lit("provide").alias("side"), blank.alias("method"), F.regexp_extract(text, EXPORT, 1).alias("raw")))
    names = F.when(F.col(text).rlike(IMPORT), F.split(F.regexp_extract(text, IMPORT, 1), r"\s*,\s*"))
    imports = F.transform(names, lambda n: F.struct(F.lit("ffi").alias("kind"), F.lit("consume").alias("side"), blank.alias("method"), F.trim(n).alias("raw")))
    all_ = F.concat(F.array_compact(F.array(rule, export)), F.coalesce(imports, F.array().cast("array<struct<kind:string,side:string,method:string,raw:string>>")))
    out = lines.withColumn("_half", F.explode(all_)).select("*", "_half.*").drop("_half")
    return out.withColumn("key", F.when(F.col("kind") == "ffi", name_key(F.col("raw"))).otherwise(route_key(F.col("raw"))))
