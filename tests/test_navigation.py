"""Shell reads as navigation calls: what is accepted, and every rule that refuses."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.navigation import rewritten

ACCEPTED = {
    'grep -rn "fn main" src': "nav search --basic -- \"fn main\" src",
    "grep -rniE 'a|b' src lib": "nav search -i -- 'a|b' src lib",
    "egrep -w x a.rs": "nav search -w -- x a.rs",
    "grep -F -A3 -B 2 'a b' f": "nav search -F -B 2 -A 3 -- 'a b' f",
    "grep -C5 x f": "nav search --basic -C 5 -- x f",
    "grep --context=4 --ignore-case --extended-regexp x f": "nav search -i -C 4 -- x f",
    "grep -rl --include=*.rs --include='*.toml' x .": "nav search --basic -l --glob *.rs,'*.toml' -- x .",
    "grep -r --exclude-dir=target --exclude-dir={.git,dist} x .": "nav search --basic -- x .",
    "grep x f 2>/dev/null | head -20 | head -n 5": "nav search --basic --head 5 -- x f 2>/dev/null",
    "grep x f | head": "nav search --basic --head 10 -- x f",
    "grep -c x f": "nav search --basic -c -- x f",
    "grep x f | wc -l": "nav search --basic -c -- x f",
    "grep -e x f": None,
    "grep -rn -- x f": "nav search --basic -- x f",
    "grep -EG x f": "nav search --basic -- x f",
    "cd /a/b && grep x f; sed -n 1,5p g": "cd /a/b && nav search --basic -- x f; nav lines 1-5 -- g",
    "X=1; grep x f": "X=1; nav search --basic -- x f",
    "sed -n '10,20p;30p' src/lib.rs": "nav lines 10-20,30-30 -- src/lib.rs",
    'sed -n -e "7,$p" a': None,
    "sed -n '7,$p' a 2>/dev/null": "nav lines 7- -- a",
    "echo 'a; b' ; grep 'x;y && z' f": "echo 'a; b'; nav search --basic -- 'x;y && z' f",
    "grep 'a$' f": "nav search --basic -- 'a$' f",
    "grep a\\ b f": "nav search --basic -- a\\ b f",
}
REFUSED = [
    "", "   ", "ls", "cd a", "NAV_RAW=1 grep x f", "grep x", "grep x -", "grep x f > out", "grep x < f", "grep $(a) f", "grep `a` f", 'grep "$X" f', "grep x f &", "grep x f || true", "grep x f && ls",
    "grep x f | sort", "grep -v x f", "grep -o x f", "grep --only-matching x f", "grep -P x f", "grep -m 3 x f", "grep x f\ngrep y g", "(grep x f)", "grep 'x f", 'grep "x f', "grep --exclude-dir=src x f", "grep -A x f", "A=1 grep x f",
    "sed 1,5p f", "sed -n 1,5d f", "sed -n 0,5p f", "sed -n 5,1p f", "sed -n 1,5p", "sed -n 1,5p f g", "sed -n 1,5p f | head", "sed -i 1,5p f", "sed -n /a/p f", "; grep x f", "grep x f ;; grep y g", "cat f | grep x g", "grep x f | head -0", "grep x f -n",
]


def test_accepts_and_refuses(spark):
    wanted = ACCEPTED | dict.fromkeys(REFUSED)
    df = spark.createDataFrame([(c,) for c in wanted], "c string")
    got = {r.c: r.r and r.r.command for r in df.select("c", rewritten(F.col("c")).alias("r")).collect()}
    assert got == wanted


def test_kinds_and_null(spark):
    df = spark.createDataFrame([("cd a; grep x f; sed -n 2p g",), (None,)], "c string")
    rows = df.select(rewritten(F.col("c")).alias("r")).collect()
    assert rows[0].r.kinds == ["search", "read"] and rows[1].r is None


@pytest.mark.parametrize("word", ["a'b c'd", '"q\\"r"', "\\'"])
def test_quoted_words_stay_as_written(spark, word):
    (row,) = spark.createDataFrame([(f"grep {word} f",)], "c string").select(rewritten(F.col("c")).alias("r")).collect()
    assert row.r.command == f"nav search --basic -- {word} f"
