"""Comments and literals of program text: nesting, raw strings, escapes, characters, what isn't closed; places stay."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import source as S


@pytest.mark.parametrize(
    ("text", "comments", "strings"),
    [
        ("a // b\nc", ["// b"], []),
        ("a /* b /* c */ d */ e", ["/* b /* c */ d */"], []),
        ('x = "a // b"; y', [], ['"a // b"']),
        ('x = "a \\" // b"; // c', ["// c"], ['"a \\" // b"']),
        ('r#"a "b" // c"# d', [], ['r#"a "b" // c"#']),
        ('br##"a"# b"## c', [], ['br##"a"# b"##']),
        ("let c = '\"'; // x", ["// x"], ["'\"'"]),
        ("f::<'a>('\\'', '\\u{1F}') // y", ["// y"], ["'\\''", "'\\u{1F}'"]),
        ("// a /* b\n\"c\"", ["// a /* b"], ['"c"']),
        ('/* "open', ['/* "open'], []),
        ('"open // x', [], ['"open // x']),
        ("for // é漢\n/*🙂*/x", ["// é漢", "/*🙂*/"], []),
        ("expr#\"x\"", [], ['"x"']),
        ("", [], []),
    ],
)
def test_spans(text, comments, strings):
    found = [(kind, text[b:e]) for b, e, kind in S.spans(text)]
    assert [x for k, x in found if k == "comments"] == comments and [x for k, x in found if k == "strings"] == strings


def test_parts_keep_places():
    rnd = random.Random(6)
    for _ in range(2000):
        text = "".join(rnd.choice(["/*", "*/", "//", '"', "\n", "a", "\\", "'", 'r#"', '"#', " é"]) for _ in range(rnd.randint(0, 20)))
        p = S.parted(text)
        for i, ch in enumerate(text):
            shown = [x[i] for x in p.values()]
            assert shown.count("\n") == 3 if ch == "\n" else sorted(shown, reverse=True)[0] == ch and shown.count(" ") >= 2
        assert all(len(x) == len(text) for x in p.values())


def test_columns(spark):
    text = 'fn a() { b("c // d"); } // e f e\n/* g\nh */ i'
    df = spark.createDataFrame([(text,), (None,)], "t string").coalesce(1)
    rows = df.select(S.parts(F.col("t")).alias("p")).select(*(S.identifiers_of(F.col(f"p.{x}")).alias(x) for x in ("code", "comments", "strings"))).collect()
    assert [tuple(x) for x in rows[0].code] == [(1, "fn"), (1, "a"), (1, "b"), (3, "i")]
    assert [tuple(x) for x in rows[0].comments] == [(1, "e"), (1, "f"), (2, "g"), (3, "h")] and [x.name for x in rows[0].strings] == ["c", "d"]
    assert rows[1].code == rows[1].comments == []


def test_shaders(spark):
    text = 'let a = "no";\nlet b = r#"\n@compute fn x()"#;\nlet c = "x: f32;\\ny: u32";'
    (row,) = spark.createDataFrame([(text,)], "t string").select(S.shader_literals(F.col("t")).alias("s")).collect()
    assert [tuple(x) for x in row.s] == [(2, 'r#"\n@compute fn x()"#'), (4, '"x: f32;  y: u32"')]
