"""Code search: translated patterns, required trigrams, and all modes against plain matching."""

import random
import re

import pytest

from sparkloom.operators import search as S
from sparkloom.operators.search import Search


@pytest.mark.parametrize(
    ("basic", "want"),
    [("a\\(b\\|c\\)\\+", "a(b|c)+"), ("f(x)", "f\\(x\\)"), ("a{2}\\{3\\}", "a\\{2\\}{3}"), ("[(|)]x?", "[(|)]x\\?"), ("[]()]", "[]()]"), ("[^](]\\.", "[^](]\\."), ("a\\", "a\\\\"), ("\\\\(", "\\\\\\(")],
)
def test_basic_expressions(basic, want):
    assert S.extended(basic) == want


@pytest.mark.parametrize(
    ("globs", "fits", "misses"),
    [
        ("*.{rs,wgsl}", ["a.rs", "x/b.wgsl"], ["c.py", "a.rs/x"]),
        ("*.toml, Cargo.*", ["x.toml", "d/Cargo.lock"], ["x.rs", "MyCargo.lock"]),
        ("src/**/*.rs", ["/w/crate/src/a/b.rs", "src/a/b/c.rs"], ["/w/crate/tests/b.rs", "mysrc/a/b.rs"]),
        ("src\\**\\*.rs", ["C:/w/src/a/b.rs"], ["C:/w/tests/b.rs"]),
        ("a?.c", ["ab.c"], ["a.c", "a/.c"]),
        ("a}b,{x,y}z", ["a}b", "xz", "yz"], ["z"]),
        ("a.b+c", ["a.b+c"], ["axb+c", "a.bbc"]),
    ],
)
def test_globs(globs, fits, misses):
    p = re.compile(S.glob_pattern(globs))
    assert all(p.search(x) for x in fits) and not any(p.search(x) for x in misses)


def test_needed():
    assert S.needed("abcd") == ("and", ["abc", "bcd"])
    assert S.needed("ABC|xyz") == ("or", ["abc", "xyz"])
    assert S.needed("abc|x") is None and S.needed("a.c") is None and S.needed("(abc)?") is None
    assert S.needed("(abc)+d") == "abc" and S.needed("^abc$") == "abc" and S.needed("(?i)abc") == "abc"
    assert S.needed("\u212abc") is None and S.needed("a(") is None


def test_needed_is_in_every_match():
    """Whatever fits a pattern holds the trigrams that the pattern is said to need."""
    rnd = random.Random(3)

    def make(depth):
        kind = rnd.randint(0, 7) if depth else 0
        if kind <= 2:
            return "".join(rnd.choice("abC") for _ in range(rnd.randint(1, 5)))
        return ["({})?", "({})+", "({}|{})", "[ab]{}", "{}.{}"][kind - 3].format(make(depth - 1), make(depth - 1))

    def holds(need, text):
        return need is None or (need in text.lower() if isinstance(need, str) else (all if need[0] == "and" else any)(holds(n, text) for n in need[1]))

    hits = 0
    for _ in range(400):
        pattern = make(3)
        need = S.needed(pattern)
        for _ in range(30):
            text = "".join(rnd.choice("abC") for _ in range(rnd.randint(0, 25)))
            if re.search(pattern, text):
                hits += 1
                assert holds(need, text), (pattern, text)
    assert hits > 500


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    words = ["fn", "main", "Let", "retry_count", "x", "(a|b)", "é", "// note", "\u212abc"]
    rows = [(f"src/d{i % 3}/f{i}.{'rs' if i % 2 else 'py'}", "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(0, 6)))) for i in range(400)]
    rows += [("src/d0/f0.py", "main again"), (None, "main\nmain"), ("empty.rs", None), ("rare.rs", "zebra\nstripes")]
    folder = f"file://{tmp_path_factory.mktemp('c')}/t"
    spark.createDataFrame(rows, "p string, t string").write.parquet(folder)
    return [(p or "", t or "") for p, t in rows], S.build(spark.read.parquet(folder), "p", "t", "test")


def plain(rows, s, pattern):
    out = []
    p = re.compile(pattern, re.I | re.A if s.ignore_case else re.A)
    for path, text in rows:
        if s.glob and not re.search(S.glob_pattern(s.glob), path):
            continue
        lines = text.split("\n")
        hit = [bool(p.search(x)) for x in lines]
        if not any(hit):
            continue
        if s.output == "files":
            out.append((path,))
        elif s.output == "count":
            out.append((path, sum(hit)))
        else:
            out += [(path, i + 1, hit[i], x) for i, x in enumerate(lines) if any(hit[max(0, i - s.context) : i + s.context + 1])]
    return sorted(out)


@pytest.mark.parametrize(
    ("s", "pattern"),
    [
        (Search("main|retry_c[a-z]*"), "main|retry_c[a-z]*"),
        (Search("MAIN", ignore_case=True, context=1, glob="*.rs"), "main"),
        (Search("(a|b)", kind="fixed", output="count"), r"\(a\|b\)"),
        (Search("re\\(try\\|x\\)", kind="basic", output="files"), "re(try|x)"),
        (Search("let", word=True, ignore_case=True, glob="d0/*,d1/*"), r"(?<![A-Za-z0-9_])let(?![A-Za-z0-9_])"),
        (Search("x", output="count"), "x"),
        (Search("zebra", context=3), "zebra"),
        (Search("nowhere"), "nowhere"),
        (Search("^$", output="files"), "^$"),
        (Search("kbc", ignore_case=True), "kbc"),
    ],
)
def test_search(corpus, s, pattern):
    rows, index = corpus
    assert sorted(map(tuple, S.search(index, s).collect())) == plain(rows, s, pattern)


def test_many_candidates_are_joined(corpus, monkeypatch):
    monkeypatch.setattr(S, "MOST_NAMED", 1)
    rows, index = corpus
    s = Search("main")
    assert sorted(map(tuple, S.search(index, s).collect())) == plain(rows, s, "main")


def test_reads_candidate_blocks_only(corpus):
    _, index = corpus
    assert S.candidates(index, "zebra").count() == 1 and S.candidates(index, "x") is None
    plan = S.search(index, Search("zebra"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan


def test_published_once(spark, tmp_path):
    """A second builder of the same folder keeps the first one's; what was made for nothing goes."""
    from pathlib import Path

    from sparkloom.sources.work import published

    def make(n):
        def run(base):
            spark.range(n).write.parquet(f"{base}/t")
            if n == 2:  # another session publishes meanwhile
                assert published(spark, tmp_path.name, make(3)).endswith(tmp_path.name)

        return run

    base = published(spark, tmp_path.name, make(2))
    assert spark.read.parquet(f"{base}/t").count() == 3
    folder = Path(base.removeprefix("file://"))
    assert [p.name for p in folder.parent.iterdir() if p.name.startswith(tmp_path.name)] == [tmp_path.name]


def test_empty_pattern_and_table(spark, tmp_path):
    with pytest.raises(ValueError):
        Search("").regex()
    spark.createDataFrame([], "p string, t string").write.parquet(f"{tmp_path}/t")
    index = S.build(spark.read.parquet(f"file://{tmp_path}/t"), "p", "t", f"none{tmp_path.name}")
    assert S.search(index, Search("abc")).collect() == [] and S.search(index, Search("a", output="count")).collect() == []
