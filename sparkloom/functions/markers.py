"""Markers in prose: [KB-TYPE name="..."]body[/KB-TYPE], as expressions. A wrong closing tag still closes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.prose import is_placeholder, without_fences

TYPES = ("PATTERN", "TRAP", "CORRECTION", "ADR", "NOTE", "SKILL", "WALL")
#: The attribute that an entry of each kind is known by; a note is known by its body.
KEYS = ("name", "description", "claim", "attempted", "title")
_VALUE = r'"((?:[^"\\]|\\.)*)"'
MARKER = rf"\[KB-({'|'.join(TYPES)})((?:\s+[a-z_]+={_VALUE.replace('((', '(?:(').replace(')*)', ')*)')})*)\s*\]([\s\S]*?)\[/KB-[A-Z]+\]"


def unescape(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1")


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, unescaped; empty if it isn't there."""
    return unescape(F.regexp_extract(attrs, rf"(?:^|\s){name}={_VALUE}", 1))


def parse(text: Column) -> Column:
    """kind, key and body of each marker outside of fenced code, in order; placeholders are left out."""

    def one(x: Column) -> Column:
        attrs, body = F.regexp_extract(x, MARKER, 2), F.trim(F.regexp_extract(x, MARKER, 3))
        named = F.coalesce(*[F.when(attribute(attrs, k) != "", attribute(attrs, k)) for k in KEYS], F.when(F.regexp_extract(x, MARKER, 1) == "NOTE", body), F.lit(""))
        return F.struct(F.lower(F.regexp_extract(x, MARKER, 1)).alias("kind"), named.alias("key"), body.alias("body"))

    found = F.transform(F.regexp_extract_all(without_fences(text), F.lit(MARKER), 0), one)
    return F.filter(found, lambda m: ~is_placeholder(m["key"]))
