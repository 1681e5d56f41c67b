"""Alignment, fill-in-middle and mixing against plain versions, with odd rows and empty tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import alignment, bpe, fim, mixing, queries

# 11. alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))


def byte_letters():
    """The letter that stands for each byte in the vocabulary's entries: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def plain_alignment(texts, tokenizers):
    a_model, b_model = tokenizers
    letters, out, linked = byte_letters(), [], Counter()
    for text in texts:
        spans = [[], []]
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            bytes_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                for side, (ids, parts) in enumerate(((a, bytes_a), (b, bytes_b))):
                    at = 0
                    for i, part in zip(ids, parts, strict=True):
                        spans[side].append((at, at + len(part), i))
                        at += len(part)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(spans[0]) < 400 else sweep_links(*spans)
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo < e <= hi) for side in spans)) if len(ends) < 400 else None
        out.append((len(spans[0]), len(spans[1]), len(ends), links, ";".join(groups) if len(groups) == len(ends) else None))
        linked.update(set(links))
    most = defaultdict(int)
    for (a, _), n in linked.items():
        most[a] = max(most[a], n)
    return [
        (na, nb, ng, len(links), sum(linked[x] == most[x[0]] for x in links), sum(linked[x] for x in links), None if shown is None else hashlib.sha256(shown.encode()).hexdigest() if na else "")
        for na, nb, ng, links, shown in out
    ]


def sweep_links(a, b):
    """Both lists of spans walked together."""
    i = j = 0
    out = []
    while i < len(a):
        out.append((a[i][2], b[j][2]))
        x, y = a[i][1], b[j][1]
        i, j = i + (x <= y), j + (y <= x)
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check_alignment(df, tokenizers, **options):
    rows = df.collect()
    want = plain_alignment([r.text for r in rows], tokenizers)
    shown = {}
    got = sorted(((r.doc_id is None, r.doc_id), *(r[x] for x in NAMES)) for r in alignment.align(df, **options).collect())
    expect = sorted(((r.doc_id is None, r.doc_id), *w) if w[6] is not None else ((r.doc_id is None, r.doc_id), *w[:6], shown.setdefault(id(w), "?")) for r, w in zip(rows, want, strict=True))
    assert [g[:7] for g in got] == [w[:7] for w in expect]
    assert all(w[7] in ("?", g[7]) for g, w in zip(got, expect, strict=True))


def test_alignment(small, odd, tokenizers):
    check_alignment(odd, tokenizers)
    check_alignment(small.limit(60).cache(), tokenizers)


def test_alignment_windows_and_joined_counts(odd, tokenizers):
    """Windows of a few bytes, so that documents pass through the machine piece by piece; counts joined by shuffling."""
    for window in (7, 64):
        check_alignment(odd, tokenizers, window=window, most_pairs=0)


def test_alignment_texts(spark, tokenizers):
    rnd = random.Random(5)
    alphabet = "ab cde  \n\t.,'\U0001f642é漢▁<0x41> \x7f<s></s>|endoftext"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += ["<|endoftext|> a<|endoftext|>", " ", "  ", "a ", " a", "<s>", "<unk>", "�", "x" * 200, "▁"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).cache()
    check_alignment(df, tokenizers)
    check_alignment(df, tokenizers, window=5)


def test_alignment_empty(empty):
    assert alignment.align(empty).collect() == []


def test_alignment_bad_bytes(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(x'61ff62' as string)").alias("text"))
    (row,) = alignment.align(df).collect()
    assert [row[x] for x in NAMES] == [0, 0, 0, 0, 0, 0, ""]


# 12. fill in the middle


def plain_cut(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def check_cuts(df):
    key = lambda r: (r[0] is None, r[0], r[5])
    want = sorted(((r.doc_id, *plain_cut(r.doc_id, r.text)) for r in df.collect()), key=key)
    out = fim.fill_in_middle(df)
    assert sorted((tuple(r) for r in out.collect()), key=key) == want
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter((r.doc_id, r.t) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in df.collect())


def test_fill_in_middle(spark, small, odd):
    check_cuts(odd)
    check_cuts(small)
    texts = ["a<P", "<<", "S>x<", "P>", ">M<", "<P>", "x<M>y", "<S<P", "ab", "é", "\U0001f642" * 700 + "a" * 900]
    df = spark.createDataFrame([(i, t) for i in range(60) for t in texts], "doc_id long, text string").repartition(7)
    check_cuts(df)


def test_boundary_list():
    rnd = random.Random(2)
    for n in (0, 1, 2, 255, 256, 257, 1000, 5000):
        for kinds in ("a", "aé", "漢", "a漢\U0001f642", "\U0001f642"):
            text = "".join(rnd.choice(kinds) for _ in range(n))
            index = fim.boundary_list(text.encode())
            starts = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(int).tolist() if n else [0]
            assert [fim.select(index, k) for k in range(n + 1)] == starts
            assert len(index) <= 21 + n * 4 // fim.SAMPLE + 4 + (2 + math.log2(4)) * n / 8 + 4
    assert fim.select(fim.boundary_list(b"\x80\x80"), 1) == 2 and fim.select(fim.boundary_list(b"\x80a"), 0) == 0


def test_fill_in_middle_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op12_fill_in_middle(spark, sf)
    rel = con.execute(queries.ORACLE["op12_fill_in_middle"])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(rel.fetchall()) == sorted(tuple(r[c] for c in names) for r in got.collect())


def test_fill_in_middle_empty(empty):
    assert fim.fill_in_middle(empty).collect() == []


# 13. mixing


def plain_targets(sizes):
    """Weights 1, 2, 3 by code point, null last; the excess over three times a source is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        share = total - sum(fixed.values())
        t = {s: share * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 3 * sizes[s] for s in rest if t[s] > 3 * sizes[s]}
        if not over:
            return fixed | t
        fixed |= over


def plain_rates(sizes, target):
    """The dual by bisection: rates min(3, exp(dual * size)) with the target as their words."""
    words = lambda x: sum(s * min(3.0, math.exp(min(x * s, 50))) for s in sizes)
    lo, hi = -60.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
    return {s: min(3.0, math.exp(min(lo * s, 50))) for s in sizes}


def check_mix(df, close=1e-5):
    count = lambda t: len((t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")) - (t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ").count("")
    rows = [(r.doc_id, r.source, count(r.text)) for r in df.collect()]
    of = defaultdict(list)
    for _, source, n in rows:
        of[source].append(n)
    sizes = {s: sum(x) for s, x in of.items()}
    targets = plain_targets(sizes)
    rates = {s: plain_rates([x for x in of[s] if x], targets[s]) for s in of}
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((d, n, sizes[s]) for d, s, n in rows)
    by = defaultdict(lambda: [0, []])
    source_of = {(d, n): s for d, s, n in rows}
    for r in got:
        s = source_of[r.doc_id, r["size"]]
        assert abs(r.target - targets[s]) <= 1e-6 * max(1, targets[s])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        if r["size"]:
            assert abs(r.rate - rates[s][r["size"]]) <= close * max(1, r.rate) + 1e-9
        else:
            assert r.rate == r.copies == 1
        by[s][0] += r.taken
        by[s][1].append(r["size"])
    for s, (taken, mine) in by.items():
        longest = max(mine)
        assert abs(taken - targets[s]) <= longest, (s, taken, targets[s])
    again = mixing.mix(df.repartition(3, "text")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix(small, odd):
    check_mix(small)
    check_mix(odd.where("doc_id is not null"), 1e-3)


def test_mix_hot_cells(spark, monkeypatch):
    """A third of all rows are copies in one source: their cell is ranked in parts."""
    monkeypatch.setattr(mixing, "HOT_ROWS", 50)
    monkeypatch.setattr(mixing, "HOT_CELLS", 4)
    rows = [(i, "hot", "a b c") for i in range(900)] + [(1000 + i, None if i % 7 == 0 else f"s{i % 5}", "w " * (i % 90)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    check_mix(df)
    got = mixing.mix(df).where("source_size = 2700").groupBy("copies").count().collect()
    assert len(got) == 2 and max(r.copies for r in got) - min(r.copies for r in got) == 1


def test_mix_targets(spark):
    rnd = random.Random(4)
    for _ in range(6):
        sizes = {f"s{i}": rnd.choice([0, 1, 7, 50, 1000, 10**6, 10**12]) for i in range(rnd.randint(1, 9))} | {None: 5}
        rows = [(s or "", s is None, n) for s, n in sizes.items()]
        got = mixing.targets(spark.createDataFrame(rows, "src string, no_src boolean, source_size long")).collect()
        want = plain_targets(sizes)
        for r in got:
            assert math.isclose(r.target, want[None if r.no_src else r.src], rel_tol=1e-9, abs_tol=1e-6)


def test_mix_odd(spark, odd, empty):
    assert mixing.mix(empty).collect() == []
    assert mixing.mix(odd).count() == odd.count()
    blank = spark.createDataFrame([(1, None, None), (2, "a", " "), (None, "a", "")], "doc_id long, source string, text string")
    assert [(r.taken, r.target, r.copies) for r in mixing.mix(blank).collect()] == [(0, 0.0, 1)] * 3
