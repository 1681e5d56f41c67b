"""Joins by parts of texts against comparing all with all."""

import random

from sparkloom.operators import contains as C


def test_contained_and_ending(spark):
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abAB é\n🙂.%") for _ in range(n))
    texts = [(i, make(rnd.randint(0, 30))) for i in range(200)] + [(900, None), (901, ""), (902, "aaaa" * 500)]
    needles = list({make(rnd.randint(1, 6)) for _ in range(150)}) + ["zzz", "aaaa", "A", "🙂", "%"]
    n = spark.createDataFrame([(x,) for x in [*needles, *needles[:5], None, ""]], "n string").repartition(3)
    t = spark.createDataFrame(texts, "k int, t string").repartition(3)
    got = sorted(map(tuple, C.contained(n, "n", t, "k", "t").collect()))
    assert got == sorted((x, k) for x in set(needles) for k, s in texts if s is not None and x.lower() in s.lower())
    ends = sorted(map(tuple, C.ending(n, "n", t, "k", "t").collect()))
    assert ends == sorted((x, k) for x in set(needles) for k, s in texts if s is not None and s.lower().endswith(x.lower()))


def test_nothing_asked(spark):
    none = spark.createDataFrame([(None,), ("",)], "n string")
    texts = spark.createDataFrame([(1, "a")], "k int, t string")
    assert C.contained(none, "n", texts, "k", "t").collect() == [] and C.ending(none, "n", texts, "k", "t").collect() == []
    some = spark.createDataFrame([("a",)], "n string")
    assert C.contained(some, "n", texts.limit(0), "k", "t").collect() == []


def test_held_needs_no_pairs(spark, monkeypatch):
    """Short needles that all texts hold: no row for each needle and text, which contained() makes."""
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("abAB é\n🙂.%") for _ in range(n))
    texts = [(i, make(rnd.randint(0, 40))) for i in range(150)] + [(900, None), (901, ""), (902, "xyzw" * 9)]
    needles = list({make(rnd.randint(1, 5)) for _ in range(150)}) + ["zzz", "A", "wxYZ" * 8, "wxyz" * 9, "xyzw" * 4]
    n = spark.createDataFrame([(x,) for x in [*needles, *needles[:5], None, ""]], "n string").repartition(3)
    t = spark.createDataFrame(texts, "k int, t string").repartition(3)
    want = sorted(x for x in set(needles) if any(x.lower() in s.lower() for _, s in texts if s))
    short = n.where("length(n) <= 16 or n is null")
    assert sorted(r.n for r in C.held(n, "n", t, "k", "t").collect()) == want
    asked = []
    pairs = C.contained
    monkeypatch.setattr(C, "contained", lambda needles, *a: asked.append(needles.count()) or pairs(needles, *a))
    assert sorted(r.n for r in C.held(short, "n", t, "k", "t").collect()) == [x for x in want if len(x) <= 16]
    assert asked == [0]
    assert C.held(n.where("n = ''"), "n", t, "k", "t").collect() == [] and C.held(n, "n", t.limit(0), "k", "t").collect() == []
