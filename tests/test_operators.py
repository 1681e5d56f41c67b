"""Operators against plain versions on random data, and streams against tables."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import boundaries, commands, prose, stems
from sparkloom.operators import code, graph, index, learning, relational, similarity
from sparkloom.sources import files
from sparkloom.streaming import jobs, verdicts


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("o")).first().o


def texts(seed, n=60, words=40):
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.zipf(1.6, 12) % words] for _ in range(12)]
    return [(i, " ".join(rng.permutation(base[int(rng.integers(12))])[: int(rng.integers(5, 13))])) for i in range(n)]


def brute_pairs(rows):
    tf = {i: Counter(t.split()) for i, t in rows}
    df = Counter(w for c in tf.values() for w in c)
    vec = {}
    for i, c in tf.items():
        v = {w: (1 + math.log(n)) * math.log(len(rows) / df[w]) for w, n in c.items() if df[w] < len(rows)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {w: x / norm for w, x in v.items()} if norm else {}
    return {(a, b): sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) for a, b in itertools.combinations(sorted(vec), 2)}


@pytest.mark.parametrize("threshold", [0.2, 0.55, 0.9])
def test_similar_pairs(spark, threshold):
    rows = [(i, t.replace("w", "wor")) for i, t in texts(5)]
    terms = similarity.weighted_terms(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = {(r.a, r.b): r.cosine for r in similarity.similar_pairs(terms, "id", threshold).collect()}
    want = {k: v for k, v in brute_pairs(rows).items() if v >= threshold}
    assert len(want) > 3 and set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_leaders(spark):
    rows = [(i, t.replace("w", "wor")) for i, t in texts(6)]
    pairs = {k: v for k, v in brute_pairs(rows).items() if v >= 0.4}
    items = spark.createDataFrame([(i, (i * 37) % 61) for i, _ in rows], "id long, o long")
    want, lead = {}, []
    for i in sorted(range(len(rows)), key=lambda i: (i * 37) % 61):
        near = [(pairs[min(i, x), max(i, x)], -n, x) for n, x in enumerate(lead) if (min(i, x), max(i, x)) in pairs]
        want[i] = max(near)[2] if near else i
        lead += [] if near else [i]
    df = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "a long, b long, cosine double")
    assert {r.id: r.leader for r in learning.leaders(items, df, "id", "o").collect()} == want
    assert {r.leader for r in learning.leaders(items, df.limit(0), "id", "o").collect()} == set(range(len(rows)))


def test_greedy_matching(spark):
    rng = np.random.default_rng(4)
    pairs = [(a, b, float(rng.integers(1, 6)) / 10) for a in range(9) for b in range(9) if rng.random() < 0.5]
    want, ua, ub = set(), set(), set()
    for a, b, j in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in ua and b not in ub:
            want.add((a, b, j))
            ua.add(a)
            ub.add(b)
    df = spark.createDataFrame(pairs, "a long, b long, jaccard double")
    assert {tuple(r) for r in graph.greedy_matching(df).collect()} == want
    assert graph.greedy_matching(df.limit(0)).collect() == []


def test_reach_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_id string, to_id string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.distance) for r in graph.reach(edges, roots, 5).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    plan = graph.reach(edges, roots, 4)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 0  # every level is a written table


WORDS = {
    "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration",
    "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "decisiveness": "decis", "triplicate": "triplic", "electrical": "electr",
    "goodness": "good", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is",
}


def test_stems(spark):
    assert {w: stems.stem(w) for w in WORDS} == WORDS
    df = spark.createDataFrame([(w,) for w in [*WORDS, None]], "w string")
    assert {r.w: r.s for r in df.select("w", stems.stems(F.col("w")).alias("s")).collect()} == WORDS | {None: None}


def test_full_text_by_stems(spark, tmp_path):
    rows = [(1, "Relational operators", "joins"), (2, "sets", "an operator relates rows; operating"), (3, "other", "nothing"), (4, None, None)]
    spark.createDataFrame(rows, "id long, name string, body string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    i = index.build(docs, "id", ["name", "body"], "test", stemmed=True)
    any_ = {r.key: r.score for r in index.full_text(i, ["operators"], [10, 1]).collect()}
    assert set(any_) == {1, 2} and any_[1] > any_[2]  # a match in a name outranks one in a body
    assert [r.key for r in index.full_text(i, ["relate", "joins"], [10, 1], every=True).collect()] == [1]
    again = index.build(docs, "id", ["name", "body"], "test", stemmed=True)
    assert again.postings.inputFiles() == i.postings.inputFiles()
    spark.createDataFrame(rows[:1], "id long, name string, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    changed = index.build(spark.read.parquet(str(tmp_path / "t")), "id", ["name", "body"], "test", stemmed=True)
    assert changed.corpus.first().n == 5


def test_expressions(spark):
    assert one(spark, commands.family, "cd a && FOO=1 /usr/bin/Make all") == "make" and one(spark, commands.family, "") == "(unknown)"
    assert one(spark, commands.family, "time cargo test") == "cargo"
    assert one(spark, commands.after_cd, "cd a&b && cd c; ls") == "ls"
    assert one(spark, commands.without_ansi, "\x1b[31mred\x1b[0m") == "red"
    assert one(spark, boundaries.route_key, "https://h:1/A/{id}/B?x=1#y") == "/a/*/b" and one(spark, boundaries.route_key, "http://h") == "/"
    assert one(spark, prose.minutes, "v2 then 45-minutes") == 45 and one(spark, prose.minutes, "30.0.1") is None and one(spark, prose.minutes, "~1.5 h") == 90
    assert one(spark, prose.valid_date, "2024-02-30") is False and one(spark, prose.valid_date, "2024-02") is True
    assert one(spark, lambda t: code.split_top_level(t), "a: Map<K, V>, f(x, y), z") == ["a: Map<K, V>", "f(x, y)", "z"]
    assert one(spark, prose.token_estimate, "éé") == 1 and one(spark, prose.token_estimate, None) == 1
    assert one(spark, lambda t: prose.opening_clause(t, 40), "x" * 35 + "; rest of the text is long") == "x" * 35 + " …"


def test_kept_paths(spark):
    paths = ["src/a.rs", "target/x.rs", "src/target/y", "logs/a", "src/logs/b.txt", "a.tmp", "deep/a.tmp", "targets/z"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.where(files.kept_path(F.col("p"), ["/logs", "*.tmp", "# no"])).collect()]
    assert got == ["src/a.rs", "src/logs/b.txt", "targets/z"]


def test_verdicts_flip_and_repeat(spark, tmp_path):
    rows = [("s", 1, 5, None), ("s", 2, 6, None), ("s", 3, None, True), ("s", 4, 7, None), ("s", 5, None, True), ("s", 6, None, False), ("t", 7, 5, None), ("u", 8, None, False)]
    rows += [("v", 20 + i, i, None) for i in range(15)] + [("v", 50, None, False), ("v", 51, None, True)]
    df = spark.createDataFrame(rows, "sess string, id long, entry long, passed boolean")
    table = verdicts.credits_of_table(df)
    want = {("s", 5, 1, 1), ("s", 6, 1, 1)} | {("v", i, 1, 0) for i in range(12)}
    assert {tuple(r) for r in table.collect()} == want
    for i, part in enumerate((rows[:5], rows[5:20], rows[20:])):  # a session goes on in a later file
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = jobs.append_to(verdicts.credits_of_stream(jobs.stream_of(spark, str(tmp_path / "in"), 1)), f"file://{tmp_path}/job")
    got = changes.groupBy("sess", "entry").agg(F.sum("use"), F.sum("reverted")).collect()
    assert {tuple(r) for r in got} == want and i == 2


def test_debounced_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 1), ("b", 1), ("a", 2)]
    df = spark.createDataFrame(rows, "path string, s long").select("path", F.timestamp_seconds("s").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = jobs.append_to(jobs.debounced(jobs.stream_of(spark, str(tmp_path / "in")), "path", "at"), f"file://{tmp_path}/job")
    assert Counter(r.path for r in got.collect()) == {"a": 1, "b": 1}


def test_leaders_of_a_long_chain(spark):
    """Each item is like the one before: rounds as long as the chain, and decided ones are gathered on the way."""
    from sparkloom.operators import learning as L

    n = 20
    items = spark.createDataFrame([(i, i) for i in range(n)], "id int, o int")
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(n - 1)], "a int, b int, cosine double")
    got = {r.id: r.leader for r in L.leaders(items, pairs, "id", "o").collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_reachable_with_cycles(spark):
    from sparkloom.operators import graph as G

    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")], "from_id string, to_id string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "d"), ("a", "e"), ("b", "e"), ("x", "x"), ("e", "a"), ("a", "d")], "a string, b string")
    got = {(r.a, r.b): r.reached for r in G.reachable(edges, pairs, 3).collect()}
    assert got == {("a", "a"): True, ("a", "d"): True, ("a", "e"): False, ("b", "e"): True, ("x", "x"): True, ("e", "a"): False}


def test_redaction_cuts_whole_characters_once(spark):
    """Long texts end before a whole character, within the bytes allowed, and stay as they are when done again."""
    from sparkloom.functions import text as X

    texts = ["x" * (8144 - k) + "é漢🙂"[i] * 3000 for k in range(4) for i in range(3)] + ["y" * 8192, "y" * 8193, "é" * 4096]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.redact(F.col("t")).alias("a")).select("i", "a", X.redact(F.col("a")).alias("b"))
    for r in df.collect():
        raw = texts[r.i].encode()
        assert r.a == r.b and len(r.a.encode()) <= 8192
        if len(raw) <= 8192:
            assert r.a == texts[r.i]
        else:
            head, note = r.a.split("...[")
            assert texts[r.i].startswith(head) and 8144 - 4 < len(head.encode()) <= 8144 and note == f"{len(raw) - len(head.encode())} bytes truncated]"


@pytest.mark.parametrize("block", [7, 20_000])
def test_copies_meet_as_classes_in_blocks(spark, monkeypatch, block):
    """Copies are one class: no row for each pair of them; nearest, nearest older and leaders are those of all pairs."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows = [(i, t.replace("w", "wor")) for i, t in texts(7, 40)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(90, ""), (91, "worn"), (92, "worn worn")]
    docs = spark.createDataFrame([(i, t, (i * 7) % 50, "xy"[i % 2]) for i, t in rows], "id long, t string, at long, kind string")
    pairs = {k: v for k, v in brute_pairs(rows).items() if v >= 0.3}
    terms = similarity.weighted_terms(docs, "id", "t")
    members, found = similarity.similar_classes(terms, "id", 0.3)
    assert {(r.a, r.b) for r in similarity.similar_pairs(terms, "id", 0.3).collect()} == set(pairs)
    of = {r.id: r.rep for r in members.collect()}
    assert found.count() == len({tuple(sorted((of[a], of[b]))) for a, b in pairs if of[a] != of[b]}) < len(pairs) / 3
    both = [(a, b, v) for (a, b), v in pairs.items()] + [(b, a, v) for (a, b), v in pairs.items()]
    want = {i: max((round(v, 9), -b) for a, b, v in both if a == i) for i in {a for a, _, _ in both}}
    assert {r.id: (r.cosine, -r.nearest) for r in similarity.nearest(terms, "id", 0.3).collect()} == want
    at, kind = {i: (i * 7) % 50 for i, _ in rows}, {i: "xy"[i % 2] for i, _ in rows}
    older = [(a, b, v) for a, b, v in both if at[b] < at[a] and kind[a] == kind[b]]
    want = {i: max((round(v, 9), -b) for a, b, v in older if a == i) for i in {a for a, _, _ in older}}
    got = similarity.nearest_older(members, found.withColumn("cosine", F.round("cosine", 9)), docs, "id", "at", "kind").collect()
    assert {r.id: (r.cosine, -r.nearest) for r in got} == want
    items = docs.select("id", (F.col("at") * 1000 + F.col("id")).alias("o"))
    plain = learning.leaders(items, similarity.similar_pairs(terms, "id", 0.3).withColumn("cosine", F.round("cosine", 9)), "id", "o").collect()
    assert sorted(map(tuple, learning.leaders_of_classes(items, members, found.withColumn("cosine", F.round("cosine", 9)), "id", "o").collect())) == sorted(map(tuple, plain))


def shuffled(spark, run):
    """Bytes and rows that the stages of run() write to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        stages = [stages.apply(i) for i in range(stages.size())]
        return np.array([sum(s.shuffleWriteBytes() for s in stages), sum(s.shuffleWriteRecords() for s in stages)])

    before = total()
    run()
    return total() - before


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """Many blocks shuffle no more than few do: a class isn't sent once for every block."""
    rows = [(i, t.replace("w", "wor") + f" own_{i}") for i, t in texts(9, 150)]
    terms = similarity.weighted_terms(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    sent = {}
    for block in (10, 20_000):
        monkeypatch.setattr(similarity, "BLOCK", block)
        sent[block] = shuffled(spark, lambda: similarity.similar_classes(terms, "id", 0.3))[0]
    assert sent[10] < 2 * sent[20_000]


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.55, 0.95])
def test_close_pairs_are_those_of_whole_vectors(threshold, monkeypatch):
    """What is left out at first loses no pair, whatever the vectors' lengths and however the work is cut."""
    monkeypatch.setattr(similarity, "_PRODUCTS", 300)
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((90, 40)) < np.linspace(0.02, 0.6, 40), rng.random((90, 40)) ** 3, 0)
    dense[:, 20] += 0.01
    dense[7], dense[8, :20] = dense[3], dense[4, :20] * 2
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    block = lambda d: similarity.Block(np.nonzero(d)[1] * 1000 + 5, d[np.nonzero(d)], (d != 0).sum(1))
    found = lambda x, y: {(i, j): c for f in similarity.close_pairs(x, y, threshold) for i, j, c in zip(*f, strict=True)}
    for got, want, same in ((found(block(dense[:50]), block(dense[50:])), dense[:50] @ dense[50:].T, False), (found(b := block(dense), b), dense @ dense.T, True)):
        pairs = {(i, j) for i, j in zip(*np.nonzero(want >= threshold), strict=True) if not same or i < j}
        assert set(got) == pairs and all(math.isclose(c, want[k], rel_tol=1e-9) for k, c in got.items())


def test_pairs_are_made_of_the_rows_asked_for(spark):
    """Pairs of one group among some rows; other pairs of copies are not made on the way."""
    rows = [(i, t.replace("w", "wor")) for i, t in texts(11, 40)]
    rows += [(100 + i, rows[3][1]) for i in range(160)]
    group = {i: "pqrs"[i % 4] for i, _ in rows if i % 5}
    terms = similarity.weighted_terms(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    of = spark.createDataFrame(list(group.items()), "id long, g string")
    pairs = similarity.similar_pairs(terms, "id", 0.3, of)
    got = pairs.collect()
    want = {k for k, v in brute_pairs(rows).items() if v >= 0.3 and k[0] in group and k[1] in group and group[k[0]] == group[k[1]]}
    assert {(r.a, r.b) for r in got} == want
    assert len(got) == len(want)
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert sum("(g#" in j for j in joins) == 2  # between classes and within one


def test_copies_do_not_meet_older_offers_one_by_one(spark):
    """Two hundred copies beside a hundred similar classes: no row for each copy and class is made."""
    docs = spark.createDataFrame([(i, 1000 + i % 150, "k") for i in range(300)], "id long, at long, kind string")
    members = spark.createDataFrame([(i, 0 if i < 200 else i) for i in range(300)], "id long, rep long")
    cosine = {i: 0.5 + i * 7 % 100 / 1000 for i in range(200, 300)}
    pairs = spark.createDataFrame([(0, i, c) for i, c in cosine.items()], "a long, b long, cosine double")
    near = similarity.nearest_older(members, pairs, docs, "id", "at", "kind")
    got = {r.id: (r.cosine, r.nearest) for r in near.collect()}
    at = {i: 1000 + i % 150 for i in range(300)}
    of = lambda i, j: (1.0 if max(i, j) < 200 else cosine[max(i, j)] if min(i, j) < 200 else 0, -j)
    want = {i: max((of(i, j) for j in range(300) if at[j] < at[i] and of(i, j)[0]), default=None) for i in range(300)}
    assert got == {i: (c, -j) for i, w in want.items() if w for c, j in [w]}
    made, plans = [], [near._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kids = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        plans += kids
        made += [p.metrics().apply("numOutputRows").value()] if "Join" in p.nodeName() and p.metrics().contains("numOutputRows") else []
    assert made
    assert max(made) < 200 * 100 / 4


def test_amounts_as_c_prints_them(spark):
    """Billions as the query's SQL has them, halves as C rounds them; ceilings of exact hundredths."""
    numbers = [0, 999, 1000, 1500, 2500, 3500, 999_500, 1_250_000, 1_350_000, 1_450_000, 1_150_000, 1_750_000, 999_950_000, 1_234_567_890, 60_050_000_000, *range(1_050_000, 9_000_000, 100_000)]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", prose.amount(F.col("n"), billions=False).alias("m"), prose.amount(F.col("n")).alias("b")).collect()
    small = lambda n: "%.1fM" % (n / 1e6) if n >= 1e6 else "%.0fk" % (n / 1e3) if n >= 1e3 else str(n)
    assert [(r.m, r.b) for r in got] == [(small(r.n), "%.2fB" % (r.n / 1e9) if r.n >= 1e9 else small(r.n)) for r in got]


def test_attach_makes_no_pairs_of_one_name(spark):
    """Many parts and types of one name: each part meets one row for each beginning of its path."""
    paths = ["a", "a::b", "a::b::c", "a::c", "b", "", "a::b::c::d"]
    parts, types = [(i, "n", paths[i % 7]) for i in range(70)], [(i, "n", paths[i % 5 + 1]) for i in range(60)] + [(99, "m", "a")]
    p, t = spark.createDataFrame(parts, "part long, name string, module string"), spark.createDataFrame(types, "id long, name string, module string")
    common = lambda a, b: next((i for i, (x, y) in enumerate(itertools.zip_longest(a.split("::"), b.split("::"))) if x != y), len(a.split("::")))
    want = [(i, *max((common(m, k), j) for j, n, k in types if n == "n")[::-1]) for i, _, m in parts]
    assert sorted(map(tuple, code.attach(p, t).collect())) == want
    joined = code.attach(p, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "overlap" in joined.split("Join Inner, ")[1].split("\n")[0]


@pytest.mark.parametrize("run", [5, 1_000_000])
def test_index_is_built_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch, run):
    """Rows of one key are one text, in runs of any size; the postings' job has one stage."""
    monkeypatch.setattr(index, "RUN", run)
    monkeypatch.setattr(index, "SPREAD", 0)
    rows = [(i, f"the Ring {'ring ' * (i % 4)}rings éa x", None if i % 5 == 0 else f"the rings of_{i % 3}") for i in range(40)] + [(7, "ring other", "the"), (None, "ring", ""), (None, "ring a", "b")]
    rows += [(90, "", None), (91, "word " * 50 + "end", "word")]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "id long, a string, b string").repartition(3).write.parquet(path)
    for stemmed in (False, True):
        i = index.build(spark.read.parquet(path), "id", ["a", "b"], f"kinds-{stemmed}-{run}", stemmed)
        counts, split = Counter(), (lambda t: [x for x in t.lower().replace("_", " " if stemmed else "_").split() if x])
        for k, *texts_ in rows:
            counts.update((stems.stem(w) if stemmed else w, k, f) for f, t in enumerate(texts_) for w in split(t or ""))
        size, norm = Counter(), Counter()
        for (t, k, f), n in counts.items():
            size[k] += n
            if len(t.encode()) >= 3 and t not in prose.VECTOR_STOP:
                norm[k] += n * sum(counts.get((t, k, g), 0) for g in (0, 1))
        got = i.postings.collect()
        assert {(r.term, r.key, r.field): (r.tf, r.len, round(r.norm, 9)) for r in got} == {k: (n, size[k[1]], round(math.sqrt(norm[k[1]]), 9)) for k, n in counts.items()} and len(got) == len(counts)
        for f in spark.read.parquet(path).inputFiles()[:1]:  # one file of texts gives one file of postings: nothing was dealt anew
            assert len(index.build(spark.read.parquet(f), "id", ["a", "b"], f"one-{stemmed}-{run}", stemmed).postings.inputFiles()) == 1


def test_facets_are_dealt_by_id_before_they_are_made(spark):
    """Equal facets of repeated rows come once, and only bodies are shuffled."""
    u = spark.createDataFrame([(i % 20, "fields: a: x, b: y\nmethods: m | n | m\ndocs: none") for i in range(60)], "id long, body string")
    found = code.facets(u)
    assert found.count() == 20 * 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id#") == plan.count("Exchange hashpartitioning") == 1


def test_merged_intervals_are_dealt_by_their_number(spark):
    """More rows are more tasks, also where only some keys are long; ties are joined row by row, as the SQL's frames do."""
    rng = np.random.default_rng(16)
    rows = [(int(k), int(s), int(s + d)) for k, s, d in zip(rng.integers(0, 300, 4000), rng.integers(0, 200, 4000), rng.integers(-3, 9, 4000), strict=True)]
    rows += [(999, 10, 3), (999, 10, 3), (1000, 5, 20), (1000, 30, 10), (1000, None, 4), (1000, 40, None), (None, 1, 2), (None, 3, 4)]
    want, order = Counter(), lambda r: tuple((x is not None, x or 0) for x in r)
    for _, group in itertools.groupby(sorted(rows, key=order), key=lambda r: r[0]):
        islands, seen = [[]], None
        for r in group:
            if seen is None or (r[1] is not None and r[1] > seen + 1):
                islands.append([])
            islands[-1].append(r)
            seen = r[2] if seen is None else max(seen, r[2] if r[2] is not None else seen)
        for i in filter(None, islands):
            want[(i[0][0], min((r[1] for r in i if r[1] is not None), default=None), max((r[2] for r in i if r[2] is not None), default=None), len(i))] += 1
    df = spark.createDataFrame(rows, "key long, s long, e long")
    assert Counter(map(tuple, relational.merge_intervals(df, "key", "s", "e").collect())) == want
    dealt = relational.merge_intervals(df, "key", "s", "e", most=100)
    assert Counter(map(tuple, dealt.collect())) == want
    assert dealt.rdd.getNumPartitions() == 41 and dealt.rdd.mapPartitions(lambda p: [sum(r.n for r in p)]).max() < 400
