"""Program text with its comments and literals told apart: each part at its own place, the rest blank.

Nested comments need a counter, so the text is scanned in Python, in batches; what is made of the parts is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks of shader text; one of the first kind, or two of the second, tell it.
SHADER_STRONG = ("@vertex", "@fragment", "@compute", "@group(", "@binding(", "@location(", "@builtin(", "@workgroup_size", "var<uniform>", "var<storage", "var<private>", "var<workgroup>")
SHADER_WEAK = (
    "vec2<f32>", "vec3<f32>", "vec4<f32>", "mat4x4<f32>", "mat3x3<f32>", "vec2f", "vec3f", "vec4f",
    "-> f32", "-> vec", "-> u32", ": f32", ": u32", "textureSample", "array<", "select(", "clamp(",
)
_START = re.compile(r"""//|/\*|\bb?r(#*)"|"|'(?:\\(?:[^u]|u\{[0-9a-fA-F]+\})|[^\\'\n])'""")
_NESTED, _STRING, _VISIBLE = re.compile(r"/\*|\*/"), re.compile(r'(?:\\.|[^"\\])*"?', re.S), re.compile(r"[^\n]")


def spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, kind) of comments and literals, in order; what isn't closed runs to the end."""
    at = 0
    while m := _START.search(text, at):
        sign, end = m[0], m.end()
        kind = "comments" if sign in ("//", "/*") else "strings"
        if sign == "//":
            end = text.find("\n", end)
        elif sign == "/*":
            depth = 1
            for n in _NESTED.finditer(text, end):
                depth += 1 if n[0] == "/*" else -1
                if not depth:
                    end = n.end()
                    break
            else:
                end = -1
        elif m[1] is not None:
            close = '"' + m[1]
            end = text.find(close, end)
            end = end + len(close) if end >= 0 else -1
        elif sign == '"':
            end = _STRING.match(text, end).end()
        at = len(text) if end < 0 else end
        yield m.start(), at, kind


def parted(text: str) -> dict[str, str]:
    """code, comments and strings: three texts of the same length and lines, each with its part and spaces."""
    blank = lambda x: _VISIBLE.sub(" ", x)
    out, at = {"code": [], "comments": [], "strings": []}, 0
    for begin, end, kind in spans(text):
        for name, pieces in out.items():
            before, inside = text[at:begin], text[begin:end]
            pieces += [before if name == "code" else blank(before), inside if name == kind else blank(inside)]
        at = end
    return {name: "".join(pieces) + (text[at:] if name == "code" else blank(text[at:])) for name, pieces in out.items()}


@F.pandas_udf(T.StructType([T.StructField(x, T.StringType()) for x in ("code", "comments", "strings")]))
def _parts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parted(t or "") for t in texts], columns=["code", "comments", "strings"])


def parts(text: Column) -> Column:
    """A struct of parted(); a null text is empty."""
    return _parts(text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("text", T.StringType())])))
def _literals(texts: pd.Series) -> pd.Series:
    def one(text: str) -> list[dict]:
        return [{"line": text.count("\n", 0, b) + 1, "text": text[b:e]} for b, e, kind in spans(text) if kind == "strings"]

    return pd.Series([one(t or "") for t in texts])


def shader_literals(text: Column) -> Column:
    """line and text of the string literals that hold shader code; escapes of line breaks and tabs in plain ones become blanks."""
    strong = lambda s: F.greatest(*[F.contains(s, F.lit(x)) for x in SHADER_STRONG])
    weak = lambda s: sum((F.contains(s, F.lit(x)).cast("int") for x in SHADER_WEAK), F.lit(0))
    found = F.filter(_literals(text), lambda x: strong(x["text"]) | (weak(x["text"]) >= 2))
    plain = lambda s: F.when(s.startswith('"'), F.regexp_replace(s, r"\\[ntr]", "  ")).otherwise(s)
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), plain(x["text"]).alias("text")))


def identifiers_of(part: Column) -> Column:
    """line (from 1) and name of each identifier on each line, once a line."""
    lines = F.transform(F.split(part, "\n"), lambda x, i: F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(r"[A-Za-z_]\w*"), F.lit(0))), lambda n: F.struct((i + 1).cast("long").alias("line"), n.alias("name"))))
    return F.flatten(lines)
