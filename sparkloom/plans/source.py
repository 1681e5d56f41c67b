"""Queries over program text made around the tables' addresses, and over shell commands that read it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparkloom.functions import navigation as N
from sparkloom.functions import source as S
from sparkloom.plans.catalog import query
from sparkloom.plans.stores import store, stores_sql
from sparkloom.sources.tables import read

_A = "'get_' || l || CAST(page_id % 37 AS VARCHAR(9))"
_B = "'Set' || upper(l) || CAST(page_id % 11 AS VARCHAR(9))"
#: (line, part, text) of the pieces of a file, in order; a part's pieces are the answer of what the scanner finds.
_PIECES = [
    (1, "code", f"'fn ' || {_A} || '(x: i32) {{ '"), (1, "comments", f"'// calls ' || {_B} || ' \"quoted'"), (1, "break", "chr(10)"),
    (2, "code", "'let s = '"), (2, "strings", f"'\"see ' || {_A} || ' // no comment \\\\\" /* here\"'"), (2, "code", f"'; ' || {_B} || '();'"), (2, "break", "chr(10)"),
    (3, "comments", f"'/* outer ' || {_A} || ' /* inner ' || {_B} || ' */ still ' || {_A}"), (3, "break", "chr(10)"),
    (4, "comments", "' and here */'"), (4, "code", "' call('"), (4, "strings", f"'r#\"raw \"' || {_B} || '\" // text\"#'"), (4, "code", "');'"), (4, "break", "chr(10)"),
    (5, "code", "'let c = '"), (5, "strings", "'''\"'''"), (5, "code", f"'; x.' || {_A} || '::<''a>();'"), (5, "break", "chr(10)"),
    (6, "code", "'let w = '"), (6, "strings", "CASE WHEN page_id % 3 = 0 THEN '\"@vertex fn main_' || l || '() {{\\\\n let p: vec4f; \"' WHEN page_id % 3 = 1 THEN 'r\"a: f32, clamp(' || l || ')\"' ELSE '\"only : f32\"' END"), (6, "code", "';'"),
]
_PIECES = [(n, part, text.replace("{{", "{").replace("}}", "}").replace("\\\\", "\\")) for n, part, text in _PIECES]
_FILE = "(SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1), 'x') AS l FROM {})"


def _sql_text(text: str) -> str:
    return text.replace("\\", "' || chr(92) || '")


_TEXT = " || ".join(_sql_text(t) for _, _, t in _PIECES)


def _programs(spark, sf_dir):
    read(spark, sf_dir, "pages").createOrReplaceTempView("_pages_of_queries")
    return spark.sql(f"SELECT page_id, {_TEXT} AS text FROM {_FILE.format('_pages_of_queries')} s")


_FOUND = " UNION ALL ".join(f"SELECT page_id, '{part}' AS part, {n} AS line, unnest(regexp_extract_all({_sql_text(t)}, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM f" for n, part, t in _PIECES if part != "break")


@query(f"WITH f AS {_FILE.format('pages')}, r AS ({_FOUND}), d AS (SELECT DISTINCT * FROM r) SELECT name, count(*) FILTER (part = 'code') AS code_lines, count(*) FILTER (part = 'comments') AS comment_lines, count(*) FILTER (part = 'strings') AS string_lines, count(DISTINCT page_id) AS files FROM d GROUP BY 1")
def r26_e05_references(spark, sf_dir):
    """Lines that name each identifier in code, in comments and in strings, with comments nested and literals raw."""
    p = _programs(spark, sf_dir).select("page_id", S.parts(F.col("text")).alias("p"))
    rows = [p.select("page_id", F.lit(part).alias("part"), F.explode(S.identifiers_of(F.col(f"p.{part}"))).alias("r")) for part in ("code", "comments", "strings")]
    found = reduce(lambda a, b: a.union(b), rows).select("page_id", "part", "r.line", "r.name")
    return found.groupBy("name").agg(*(F.count_if(F.col("part") == part).alias(c) for part, c in (("code", "code_lines"), ("comments", "comment_lines"), ("strings", "string_lines"))), F.count_distinct("page_id").alias("files"))


_SHADERS = _sql_text(next(t for n, part, t in _PIECES if n == 6 and part == "strings"))


@query(f"WITH f AS {_FILE.format('pages')}, s AS (SELECT page_id, {_SHADERS} AS s FROM f) SELECT page_id, 6::BIGINT AS line, CASE WHEN starts_with(s, '\"') THEN regexp_replace(s, '\\\\[ntr]', '  ', 'g') ELSE s END AS text FROM s WHERE contains(s, '@vertex') OR (contains(s, ': f32')::INT + contains(s, 'clamp(')::INT + contains(s, 'vec4f')::INT) >= 2")
def e05_shader_literals(spark, sf_dir):
    """Literals that hold shader text, with the line each starts on; breaks inside plain ones become blanks."""
    return _programs(spark, sf_dir).select("page_id", F.explode(S.shader_literals(F.col("text"))).alias("s")).select("page_id", "s.line", "s.text")


_CALL = r"'^((?:cd [^ ;&]+(?:; | && ))*)(grep -rn (\"[^\"]*\") ([a-z]+)|sed -n ([1-9][0-9]*),([0-9]+)p ([a-z./]+))$'"


@query(stores_sql("calls") + f""", c AS (SELECT id, trim(command) AS c FROM calls), m AS (SELECT id, c, {", ".join(f"regexp_extract(c, {_CALL}, {i}) AS g{i}" for i in (1, 3, 4, 5, 6, 7))} FROM c WHERE regexp_matches(c, {_CALL}))
    SELECT id, g1 || CASE WHEN g3 <> '' THEN 'nav search --basic -- ' || g3 || ' ' || g4 ELSE 'nav lines ' || g5 || '-' || g6 || ' -- ' || g7 END AS command, CASE WHEN g3 <> '' THEN 'search' ELSE 'read' END AS kinds FROM m WHERE g3 <> '' OR CAST(g6 AS INT) >= CAST(g5 AS INT)""")
def f32_navigation_calls(spark, sf_dir):
    """Shell commands that are searches or reads of lines as navigation calls; the others run as they are."""
    found = store(spark, sf_dir, "calls").select("id", N.rewritten(F.col("command")).alias("r")).where("r is not null")
    return found.select("id", "r.command", F.array_join("r.kinds", ",").alias("kinds"))
