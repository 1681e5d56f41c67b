"""Every operator against a brute-force version on small tables, with odd rows and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, exact_dedup, katz, langid, media_ts, packing, queries, simhash, substring, token_counts, toxicity
from sparkloom.llm.common import bloom_bits, bloom_hits, crc_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def tables(small, odd):
    return {"small": small, "odd": odd}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def by_key(rows, *keys):
    return sorted(rows, key=lambda r: tuple((r[k] is None, r[k]) for k in keys))


def test_bloom(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bits = bloom_bits(df, "k", 1 << 16)
    keys = np.array([r[0] for r in df.collect()], np.int64).view(np.uint64)
    assert bloom_hits(bits, keys).all()
    assert bloom_hits(bits, np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.1
    assert not bloom_hits(bloom_bits(df.limit(0), "k", 1 << 16), keys).any()


# 1. media


def test_media(tables):
    for df in tables.values():
        got = by_key([r.asDict() for r in media_ts.media_features(df).collect()], "doc_id", "payload_sha256")
        want = []
        for d, t in rows_of(df):
            b = (t or "").encode()
            p = b + b" " * (-len(b) % 192 if b else 192)
            want.append({"doc_id": d, "n_bytes": len(b), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:])})
        want = by_key(want, "doc_id", "payload_sha256")
        assert [{k: g[k] for k in w} for g, w in zip(got, want, strict=True)] == want
        assert all(g["n_counter_errors"] == 0 and g["media_bytes"] % 188 == 0 for g in got)


def test_transport_stream_faults():
    payload = media_ts.padded(bytes(range(256)) * 100)
    stream = media_ts.write_stream(payload, first_pts=(1 << 33) - 5000)
    got = media_ts.read_stream(stream)
    assert got["payloads"][media_ts.ES_PID] == payload and got["programs"] == [(1, media_ts.PMT_PID)] and got["errors"] == 0
    assert [u[1] for u in got["units"]][:3] == [(1 << 33) - 5000, (1 << 33) - 1400, 2200]  # the clock wraps
    assert [i for i, u in enumerate(got["units"]) if u[3]] == [0, 12]
    lost = stream[: 188 * 10] + stream[188 * 11 :]
    assert media_ts.read_stream(lost)["errors"] == 1
    doubled = stream[: 188 * 11] + stream[188 * 10 :]
    again = media_ts.read_stream(doubled)
    assert again["repeats"] == 1 and again["errors"] == 0 and again["payloads"] == got["payloads"]
    shifted = media_ts.read_stream(b"junk" + stream)
    assert shifted["skipped"] == 4 and shifted["payloads"] == got["payloads"]
    nothing = media_ts.read_stream(b"")
    assert nothing["programs"] == [] and nothing["units"] == []
    assert media_ts.section_crc(media_ts._PAT) == 0


def test_transport_stream_any_bytes():
    rng = np.random.default_rng(12)
    good = media_ts.write_stream(media_ts.padded(bytes(range(256)) * 30))
    for _ in range(1500):
        data = bytearray(good[: 188 * int(rng.integers(1, 20))])
        for at in rng.integers(0, min(len(data), 188 * 4), int(rng.integers(1, 12))):
            data[at] = int(rng.integers(256))
        got = media_ts.read_stream(bytes(data))
        assert all(len(got["payloads"].get(pid, b"")) >= place + n for pid, _, _, _, _, place, n in got["units"])
    for n in (1, 187, 188, 189, 1000):
        media_ts.read_stream(b"G" * n)
        media_ts.read_stream(rng.bytes(n))


def _stream(pes, pmt=None):
    """A stream with the tables and one packet that begins with pes."""
    packets = [media_ts._table_packet(media_ts.PAT_PID, media_ts._PAT, 0), media_ts._table_packet(media_ts.PMT_PID, pmt or media_ts._PMT, 0)]
    stuffing = 184 - len(pes)
    field = bytes([stuffing - 1]) + (b"\x00" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
    return b"".join(packets) + bytes([0x47, 0x41, 0x00, 0x30]) + field + pes


def test_transport_stream_short_headers():
    short = media_ts.read_stream(_stream(b"\x00\x00\x01\xbd\x00\x03\x84\x80\x00"))  # a stamp is flagged, the header has none
    assert short["units"] == [(0x100, None, None, False, False, 0, 0)]
    cut = media_ts.read_stream(_stream(b"\x00\x00\x01\xbd\x00\x00\x84\xc0\x0a\x21"))  # ends within the stamp
    assert cut["units"][0][1:3] == (None, None) and cut["payloads"][0x100] == b""
    assert media_ts.read_stream(_stream(b"\x00\x00\x01\xbd\x00\x00"))["malformed"] == 1
    bare = media_ts.read_stream(_stream(b"\x00\x00\x01\xbf\x00\x03abc"))
    assert bare["payloads"][0x100] == b"abc" and bare["units"][0][1] is None
    for size in range(0, 12):  # a program map of any length with a right CRC
        body = bytes([2, 0xB0, size + 4]) + bytes(size)
        media_ts.read_stream(_stream(b"", body + media_ts.section_crc(body).to_bytes(4, "big")))


def test_media_empty(empty):
    assert media_ts.media_features(empty).collect() == []


def test_media_malformed(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"no stream")), (3, bytearray(media_ts.write_stream(b"a" * 192)))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media_ts.parse_media(df, payload=True).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 0 and got[1].units == []
    assert bytes(got[3].payload) == b"a" * 192 and got[3].units[0].random_access


# 2. packing


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    lengths, cap = rng.integers(1, 41, 400), 40
    bins, offsets = packing.sum_of_squares(lengths, cap)
    gaps, at = [], {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        n = Counter(g for g in gaps if g)
        square = lambda m: sum(v * v for k, v in m.items() if 0 < k < cap)
        options = {}
        for g in {g for g in gaps if g >= s}:
            options[g] = square(n - Counter([g]) + Counter([g - s]))
        options[cap] = square(n + Counter([cap - s]))
        chosen = gaps[b] if b < len(gaps) else cap
        assert options[chosen] == min(options.values())
        if b == len(gaps):
            gaps.append(cap)
        assert o == cap - gaps[b]
        gaps[b] -= s
        at[b] = o
    assert min(gaps) >= 0


def test_pack(tables, tokenizer):
    for df in tables.values():
        pieces = packing.token_pieces(df, with_ids=True)
        got = [r.asDict() for r in packing.pack(pieces, shard_pieces=60).collect()]
        want = []
        for d, t in rows_of(df):
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
            cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(itertools.pairwise(cut)):
                want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted([(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got], key=key) == sorted(want, key=key)
        seqs = defaultdict(list)
        for g in got:
            seqs[g["sequence_id"]].append((g["offset"], g["length"]))
        for parts in seqs.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(parts)) and sum(parts[-1]) <= 2048
        total = sum(w[3] for w in want)
        assert len(seqs) <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_pack_few_sequences(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    got = packing.pack(packing.token_pieces(docs), shard_pieces=5_000).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert got[1] <= 1.015 * got[0] / 2048 + 1


def test_pack_until_nothing_joins(spark):
    # 64 shards of two pieces each, of which none leaves a pair that fits in its own shard only
    rows = [(i, 10 + i % 3) for i in range(128)]
    got = packing.pack(spark.createDataFrame(rows, "item string, length long"), capacity=40, shard_pieces=2).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o")).collect()
    fills = sorted(r.n for r in got)
    assert sum(fills) == sum(r[1] for r in rows) and all(r.n <= 40 and r.o == 0 for r in got)
    assert fills[0] + fills[1] > 40  # no two sequences left could be one


def test_pack_clashing_names(spark):
    got = packing.pack(spark.createDataFrame([(5, "x", "y")], "length long, _item string, Sequence_id string")).collect()
    assert got[0].length == 5 and got[0]["_item"] == "x" and got[0].offset == 0


def test_pack_empty(empty):
    assert packing.pack(packing.token_pieces(empty)).collect() == []


# 3. byte-pair encoding


TRICKY = ["", " ", "  a", "a  ", "a \n b", "\x1ca\x1c b", "x  y", "it's 'll'r e", "a' 's ", "<|endoftext|>", "a <|endoftext|> b  ", " <|endo ftext|>", "漢字 かな  🙂‍🙂 ", "\r\n\r\n x", "a\n", "\t b"]


def test_codec(small, odd_rows, tokenizer):
    c = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(5)
    alphabet = list("ab 's\n\t12.é漢 ") + ["  ", "'ll", "<|endoftext|>", " the"]
    texts = TRICKY + [t for _, t, *_ in odd_rows if t] + ["".join(rng.choice(alphabet, 40)) for _ in range(1500)] + [t for _, t in rows_of(small)]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == np.array(ids, "<u4").tobytes(), t
        assert c.decode(c.encode(t)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_chunk_joins(tokenizer):
    c = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(6)
    alphabet = list("abc 's\n1.é漢 ") + ["  ", "'ll", "<|endoftext|>", " the", " of"]
    for _ in range(400):
        data = "".join(rng.choice(alphabet, 300)).encode()
        ends = bpe.chunk_ends(data, 5, 8)
        assert ends[-1] == len(data) and all(data[e] & 0xC0 != 0x80 for e in ends[:-1])
        known = {n: bpe.chunk_record(c, data[a:b]) for n, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if rng.random() < 0.7}
        assert bpe.assemble(c, data, ends, known) == c.encode(data.decode())


def test_encode(tables, tokenizer):
    for df in tables.values():
        got = by_key([r.asDict() for r in bpe.encode_documents(df.withColumn("n_tokens", F.lit("clash"))).collect()], "doc_id", "ids_sha256")
        want = []
        for d, t in rows_of(df):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            want.append({"doc_id": d, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()})
        want = by_key(want, "doc_id", "ids_sha256")
        assert [{k: g[k] for k in w} for g, w in zip(got, want, strict=True)] == want
        assert sum(g["n_reused"] for g in got) > 0


def test_encode_empty(empty):
    assert bpe.encode_documents(empty).collect() == []


# 4. substring deduplication


def brute_spans(rows, window):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substring(spark, tables):
    rng = np.random.default_rng(7)
    base = [" ".join(f"{x}" for x in rng.integers(0, 3, n)) for n in (200, 400, 90)]
    made = [(int(i), " ".join(base[j].split()[a : a + n])) for i in range(60) for j, a, n in [(rng.integers(3), rng.integers(60), rng.integers(30, 200))]]
    tables = tables | {"made": spark.createDataFrame(made, "doc_id long, text string").repartition(5)}
    for name, df in tables.items():
        for window, phrase in ((50, 25), (12, 5)) if name == "made" else ((50, 25),):
            got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df, window, phrase).collect()]
            key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
            assert sorted(got, key=key) == sorted(brute_spans(rows_of(df), window), key=key)
            assert name == "small" or any(g[2] for g in got)


def test_substring_many_passages(spark, monkeypatch):
    """A phrase in very many passages: windows are dealt one by one; hot anchors are salted."""
    rng = np.random.default_rng(17)
    middle = [f"m{i}" for i in range(6)]
    rows = []
    for i in range(120):
        side = [f"s{x}" for x in rng.integers(0, 3, 12)]
        rows.append((i, " ".join([*side[:6], *middle, *side[6:]])))
    monkeypatch.setattr(substring, "HOT_ROWS", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (1, 1000):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df, 12, 5, most_passages=most).collect()]
        assert sorted(got) == sorted(brute_spans(rows, 12)) and sum(g[2] > 0 for g in got) > 20


def test_substring_by_the_automaton(spark, tables, monkeypatch):
    df = tables["odd"]
    monkeypatch.setattr(substring, "WINDOW", 50)

    def nothing(self, words):
        return np.zeros(0, np.int64)

    p = substring.Passages([(np.array([1]), np.array([1]), [b"a b c d e f"])], 4, 2)
    words = substring.Words([b"x a b c d e", b"b c d e"])
    assert p.phrases(words).tolist() == [2, 6]
    at = np.array([1, 2, 6])
    assert p.earlier(words, at, np.array([5, 5, 5])).tolist() == [True, True, True]
    assert p.earlier(words, at, np.array([1, 1, 0])).tolist() == [False, False, False]
    # hashes that agree where words don't
    p.words = substring.Words([b"a b c d E f"])
    assert p.earlier(words, at, np.array([5, 5, 5])).tolist() == [True, False, False]
    assert df.count() == 17


def test_substring_clashing_names(spark, odd):
    clash = odd.withColumns({n: F.lit(n) for n in ("_doc", "_key", "_spans", "n_words")})
    got = substring.remove_repeats(clash).collect()
    assert all(r["_doc"] == "_doc" and r["_key"] == "_key" and r["_spans"] == "_spans" and r["n_words"] != "n_words" for r in got)


def test_substring_empty(empty):
    assert substring.remove_repeats(empty).collect() == []


# 5. token counts


def test_token_counts(tables):
    vocabulary, byte = token_counts.pieces(bpe.tokenizer_path("piece_bpe_32k.model"))

    def viterbi(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            options = [(best[i - 1][0] + n * byte, -best[i - 1][1] - n)]
            options += [(best[j][0] + vocabulary[word[j:i]], -best[j][1] - 1) for j in range(max(0, i - 60), i) if word[j:i] in vocabulary]
            s, m = max(options)
            best.append((s, -m))
        return best[-1]

    memo = {}
    for df in tables.values():
        got = by_key([r.asDict() for r in token_counts.token_counts(df).collect()], "doc_id", "n_words", "n_tokens")
        want = []
        for d, t in rows_of(df):
            words = [w for w in WORD.findall(t or "")]
            found = [memo.setdefault(w, None) or memo.__setitem__(w, viterbi("▁" + w)) or memo[w] for w in words]
            want.append({"doc_id": d, "n_words": len(words), "n_tokens": sum(f[1] for f in found), "score": math.fsum(f[0] for f in found)})
        for g, w in zip(got, by_key(want, "doc_id", "n_words", "n_tokens"), strict=True):
            assert (g["doc_id"], g["n_words"], g["n_tokens"]) == (w["doc_id"], w["n_words"], w["n_tokens"])
            assert math.isclose(g["score"], w["score"], rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(math.fsum(map(math.exp, vocabulary.values())), 1, rel_tol=1e-9)


def test_token_counts_empty(empty):
    assert token_counts.token_counts(empty).collect() == []


# 6. simhash


def brute_print(t, k=4):
    w = WORD.findall(lower(t))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, tables):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in rng.integers(0, 9999, 300)]
    near = [(1000 + i, " ".join(w if j != i * 7 else "changed" for j, w in enumerate(words))) for i in range(40)]
    tables = tables | {"near": spark.createDataFrame(near, "doc_id long, text string")}
    for name, df in tables.items():
        rows = rows_of(df)
        prints = [brute_print(t) for _, t in rows]
        kinds = sorted(set(prints))
        root = {f: f for f in kinds}

        def find(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in itertools.combinations(kinds, 2):
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
        least = defaultdict(set)
        for (d, _), f in zip(rows, prints, strict=True):
            least[find(f)].add(d)
        smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
        want = [(d, f"{f:016x}", smallest[find(f)]) for (d, _), f in zip(rows, prints, strict=True)]
        got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)
        assert name != "near" or len(set(g[2] for g in got)) < len(set(g[1] for g in got))


def test_ball_links_random():
    rng = np.random.default_rng(9)
    f = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    for _ in range(3):
        flips = (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64))
        f = np.unique(np.concatenate([f, f ^ flips]))
    want = {tuple(sorted((int(a), int(b)))) for a, b in itertools.combinations(f.tolist(), 2) if (a ^ b).bit_count() <= 4}
    got = {tuple(sorted(p)) for pat in range(256) for p in simhash.link_pattern(f, pat, 4, block=3000).tolist()}

    def classes(pairs):
        root = {x: x for x in f.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for x in root:
            out[find(x)].add(x)
        return sorted(map(sorted, out.values()))

    assert classes(got) == classes(want)


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_near_keep_one(odd, small):
    kept = simhash.keep_one(odd, 5)
    assert kept.columns == odd.columns
    assert [r.doc_id for r in kept.where("text is null or trim(text) = ''").collect()] == [3]
    assert [r.doc_id for r in kept.where("doc_id in (7, 8, 15)").collect()] == [7]  # a copy, a near copy, a repeated row


def test_near_stage_similarity(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for group in range(60):
        words = [f"g{group}w{i}" for i in range(int(rng.integers(30, 400)))]
        for _ in range(4):
            new = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // 40)))):
                new[at] = f"x{n}"
            rows.append((n, " ".join(new)))
            n += 1
    # one large group around a text, most of whose members are only alike through it
    words = [f"hub{i}" for i in range(110)]
    rows.append((n, " ".join(words)))
    for i in range(40):
        rows.append((n + 1 + i, " ".join(f"y{i}" if j in (5 + i, 60 + i) else w for j, w in enumerate(words))))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root, alike = list(range(len(rows))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            alike.append(common / (len(sets[a]) + len(sets[b]) - common))
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(sum(lo <= x < lo + 0.05 for x in alike) >= 10 for lo in (0.8, 0.85, 0.9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {find(a) for a in range(len(rows))}
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == want

    work = simhash.Work(spark, "blocks")
    source, file, row = simhash.located(work, df)
    source = source.withColumnsRenamed({file: "file", row: "row"})
    one = work.table(simhash.set_names(source, 5).select(F.col("s").alias("node"), F.lit(0).cast("long").alias("root")).distinct(), "one")
    edges = simhash.similar(work, source, one, 5, (4, 5), block=50)
    roots = simhash.components(work, work.table(edges, "edges"))
    names = {r.doc_id: r.s for r in simhash.set_names(source, 5).collect()}
    of = {r.node: r.root for r in roots.collect()}
    assert len({of.get(s, s) for s in names.values()}) == len(want)


def test_near_stage_links_fingerprints(spark, monkeypatch):
    """Near copies at four bits or less are found by their fingerprints alone, chains and repeated words included."""
    rng = np.random.default_rng(17)
    rows = []
    for group in range(12):
        words = [f"g{group}w{i}" for i in rng.integers(0, 9999, 500)]
        for at in (0, 250, 499):
            rows.append((len(rows), " ".join("changed" if j == at else w for j, w in enumerate(words))))
    rows += [(100, "a b c d e f a b c d e"), (101, "a b c d e f a b c d e f a b c d e f"), (102, "a b c d e f g h"), (103, " "), (104, None)]
    prints, sets = [brute_print(t, 5) for _, t in rows], _near_classes([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = _near_classes([rows[a][1], rows[b][1]]) == [0, 0]
        if same and ((prints[a] ^ prints[b]).bit_count() <= 4 or rows[a][0] >= 100):  # equal sets have one name
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {rows[find(i)][0] for i in range(len(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bands = simhash.shared_bands
    with monkeypatch.context() as m:
        m.setattr(simhash, "shared_bands", lambda source, shingle: bands(source, shingle).where("false"))
        assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == want
    assert len(want) < len(rows) - 12
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == {rows[i][0] for i in sets}


# 7. Katz


def brute_katz(rows, cutoff=1):
    train = [t for d, t in rows if (0 if d is None else zlib.crc32(str(d).encode()) % 7) != 2]
    toks = lambda t: [*WORD.findall(lower(t)), None]
    c, pairs = Counter(), Counter()
    for t in train:
        w = toks(t)
        c.update(w)
        pairs.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    d = katz.discounts(Counter(pairs.values()), cutoff=cutoff)
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    context = lambda u: len(train) if u == "<s>" else c[u]
    followers = defaultdict(dict)
    for (u, w), k in pairs.items():
        if k >= cutoff:
            followers[u][w] = k * d.get(k, 1.0)

    def table(u):
        f = followers.get(u)
        if not f:
            return {}, 1.0
        held = sum(f.values())
        scale = context(u) / (context(u) + 1) if held > context(u) - 1e-9 else 1.0
        p = {w: x * scale / context(u) for w, x in f.items()}
        return p, (1 - sum(p.values())) / (1 - sum(map(p1, f)))

    cache = {}
    out = []
    for doc, t in rows:
        w = toks(t)
        score = 0.0
        for u, x in zip(["<s>", *w], w, strict=False):
            p, a = cache.setdefault(u, None) or cache.__setitem__(u, table(u)) or cache[u]
            score += math.log10(p[x] if x in p else a * p1(x))
        out.append((doc, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    for p, a in list(cache.values())[:200]:
        assert math.isclose(sum(p.values()) + a * (1 - sum(map(p1, p))), 1, rel_tol=1e-9)
    return out


@pytest.mark.parametrize(("cutoff", "buckets"), [(1, None), (2, 50)])
def test_katz(tables, cutoff, buckets):
    for df in tables.values():
        got = sorted([tuple(r) for r in katz.katz_scores(df, crc_fold(F.col("doc_id"), 7) != 2, buckets, cutoff).collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))
        want = sorted(brute_katz(rows_of(df), cutoff), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))
        for g, w in zip(got, want, strict=True):
            assert g[:4] == w[:4]
            assert math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_katz_discounts():
    n = {1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 40}
    d = katz.discounts(n, cutoff=1)
    assert all(0 < x < 1 for x in d.values())
    # what the discounts take from counts 1 to 5 is the Good-Turing mass of unseen events
    assert math.isclose(sum((1 - d[r]) * r * n[r] for r in d), n[1])
    assert katz.discounts({}, cutoff=2) == {1: 0.0, 2: 0.75, 3: 2.5 / 3, 4: 3.5 / 4, 5: 0.9}


def test_katz_keeps_single_pairs(spark, tmp_path):
    ids = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 != 2][:61]
    out = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2]
    # b follows a once; c is as frequent as b and never follows a
    texts = ["a b", "a d", "e c"] + [f"f{i} g{i}" for i in range(58)]
    rows = [*zip(ids, texts, strict=True), (out[0], "a b"), (out[1], "a c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_katz(spark, str(tmp_path)).where("held_out").collect()
    seen, unseen = ({r.doc_id: r.score for r in got}[d] for d in out[:2])
    pairs = Counter(p for t in texts for p in zip(["<s>", *t.split()], [*t.split(), None], strict=True))
    d = katz.discounts(Counter(pairs.values()), cutoff=1)
    n = sum(len(t.split()) + 1 for t in texts)
    v = len({w for t in texts for w in t.split()}) + 1
    p1 = lambda c: (c + 1) / (n + v + 1)
    start_a, end = d[2] * 2 / 61, d[1]  # counts 2 of 61, 1 of 1
    left = (1 - d[1]) / (1 - 2 * p1(1))  # a's followers b and d, once each
    assert math.isclose(seen, math.log10(start_a * d[1] / 2 * end), rel_tol=1e-9)
    assert math.isclose(unseen, math.log10(start_a * left * p1(1) * end), rel_tol=1e-9)


def test_katz_no_training(odd, empty):
    got = katz.katz_scores(odd, F.lit(False)).collect()
    assert len(got) == 17 and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert katz.katz_scores(empty, F.lit(True)).collect() == []


# 8. language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, crc_fold(F.col("doc_id"), 4) != 2)
    got = langid.identify(docs, model).where(crc_fold(F.col("doc_id"), 4) == 2)
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98
    assert got.where("lang_rejected").count() <= 2
    assert got.where("score < 0 or score > 1").count() == 0
    noise = spark.createDataFrame([(1, "zxqj kvvw qqpx wzkj xqzv jjkq " * 5), (2, "0123 !!!"), (3, None), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.identify(noise, model).collect()}
    assert all(found[i].lang_rejected for i in (1, 2, 3, 4)) and found[2].lang_pred == found[3].lang_pred == found[4].lang_pred == "und"


def _interpolated(tables, alphabet):
    def p(gram, o):
        if o == 0:
            return 1 / alphabet
        level, d, totals, kinds = tables[o]
        h, lower = gram[:-1], p(gram[1:], o - 1)
        return max(level[gram] - d, 0) / totals[h] + d * kinds[h] / totals[h] * lower if totals[h] else lower

    return p


def brute_language(rows, order=4):
    """Interpolated Kneser-Ney of dictionaries over characters as the operator sees them; rows: (lang, text) that a model is fitted on."""

    def seen(text):
        one = lambda ch: (" " if ch.isspace() else (ch.lower() if len(ch.lower()) == 1 and ord(ch) <= 0xFFFF else ch) if ch.isalpha() else "0" if ch.isdigit() else "!")
        return " " * (order - 1) + "".join(map(one, text))

    models = {}
    for lang in {x for x, _ in rows}:
        counts = Counter(s[i : i + order] for s in (seen(t) for x, t in rows if x == lang) for i in range(len(s) - order + 1))
        levels = {order: counts}
        for o in range(order - 1, 0, -1):
            levels[o] = Counter(g[1:] for g in levels[o + 1])
        tables = {}
        for o, level in levels.items():
            ones, twos = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
            totals, kinds = Counter(), Counter()
            for g, n in level.items():
                totals[g[:-1]] += n
                kinds[g[:-1]] += 1
            tables[o] = level, (ones / (ones + 2 * twos) if ones and twos else 0.5), totals, kinds

        models[lang] = _interpolated(tables, len(levels[1]) + 1)

    def entropy(text):
        s = seen(text)
        grams = Counter(s[i : i + order] for i in range(len(s) - order + 1))
        return {x: -sum(n * math.log(p(g, order)) for g, n in grams.items()) / len(text) for x, p in models.items()}

    return entropy


def test_language_brute(spark, small, odd):
    """Scores, choices and rejections as a plain model of dictionaries gives them."""
    docs = small.where("doc_id < 180")
    model = langid.fit(docs, F.lit(True))
    sample = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.col("doc_id"), F.lit(17)).alias("h")).collect()
    of = Counter(r.lang for r in sample)  # with 40 sampled documents a language holds an eighth out
    held = lambda r: of[r.lang] >= 40 and (r.h % (1 << 64) >> 3) % 8 == 0
    entropy = brute_language([(r.lang, r.text) for r in sample if not held(r)])
    own = defaultdict(list)
    for r in sample:
        if held(r) and len(r.text) >= 50:
            e = entropy(r.text)
            if min(e, key=lambda x: (e[x], x)) == r.lang:
                own[r.lang].append(e[r.lang])
    quantile = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
    assert own and min(of.values()) < 40
    limits = {x: quantile(v, 0.5) + max(1.0, 8 * (quantile(v, 0.75) - quantile(v, 0.25))) for x, v in own.items()}
    got = langid.identify(docs.unionByName(odd), model).collect()
    for r in got:
        t = r.text or ""
        if not any(ch.isalpha() for ch in t):
            assert (r.lang_pred, r.score, r.lang_rejected) == ("und", 0.0, True)
            continue
        if len(t) > 20_000:
            continue
        e = entropy(t)
        best = min(e, key=lambda x: (e[x], x))
        assert r.lang_pred == best
        assert math.isclose(r.score, 1 / sum(math.exp(-(v - e[best]) * min(len(t), 50)) for v in e.values()), rel_tol=1e-6)
        assert r.lang_rejected == (len(t) >= 20 and e[best] > limits.get(best, max(limits.values())))


def test_language_letters():
    assert not any(map(langid.has_letter, ["", "²", "①1", "½ ³_", "12 !", "_"])) and all(map(langid.has_letter, ["²a", "é", "漢", "ª"]))


def test_language_bound(spark, small):
    """Above the bound the rarest n-grams go, the same ones in each run; below it none."""
    assert langid.least_count({1: 10, 2: 5, 7: 1}, 16) == 1 and langid.least_count({1: 10, 2: 5, 7: 1}, 15) == 2
    assert langid.least_count({1: 10, 2: 5, 7: 1}, 3) == 7 and langid.least_count({1: 10}, 3) == 2 and langid.least_count({}, 3) == 1
    whole = langid.fit(small, F.lit(True))
    entries = sum(len(m.levels[-1].grams) for m in whole.models)
    few = [langid.fit(small, F.lit(True), most_entries=entries // 4) for _ in range(2)]
    assert 0 < sum(len(m.levels[-1].grams) for m in few[0].models) <= entries // 4
    assert all((a.levels[-1].grams == b.levels[-1].grams).all() and (a.levels[-1].logp == b.levels[-1].logp).all() for a, b in zip(few[0].models, few[1].models, strict=True))


def test_language_outliers_in_the_fit(spark):
    """Labelled outliers move neither the limits nor what they reject."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(100_000 + i, "zxqj kvvw qqpx wzkj xqzv jjkq " * 9, "en") for i in range(3)], docs.schema)
    clean, odd = (langid.fit(d, F.lit(True)) for d in (docs, docs.unionByName(junk)))
    assert np.abs(clean.limits - odd.limits).max() < 0.3
    noise = spark.createDataFrame([(1, "0x9f3a 77bb qzj#k vvxw 8812 zzkq jjxv " * 5)], "doc_id long, text string")
    assert langid.identify(noise, odd).first().lang_rejected


def test_language_clashing_names(odd):
    model = langid.fit(odd, F.lit(True))
    clash = odd.withColumns({n: F.lit(n) for n in ("score", "lang_pred", "lang_rejected")})
    kept = corpus_pipeline.language(odd.sparkSession, clash, "")
    assert kept.columns == clash.columns and {r.score + r.lang_pred for r in kept.collect()} <= {"scorelang_pred"}
    assert langid.identify(clash, model).schema["score"].dataType.simpleString() == "double"


def test_language_normalised():
    classes, starts = langid.characters([b"abracadabra", b"alakazam"])
    real = np.ones(len(classes), bool)
    for k in range(1, langid.ORDER):
        real[starts - k] = False
    keys, n = np.unique(langid.ngrams(classes)[real], return_counts=True)
    m = langid.KneserNey(keys, n)
    letters = np.unique(classes[real])
    for history in ("   ", "abr", "zzz", "aka"):
        h = sum(ord(ch) << 16 * (3 - i) for i, ch in enumerate(history))
        p = np.exp(m.logp(np.array([h | int(x) for x in letters], np.uint64))).sum()
        unseen = math.exp(m.logp(np.array([h | 0x999], np.uint64))[0])
        assert math.isclose(p + unseen, 1, rel_tol=1e-9)


def test_language_odd(odd, empty):
    model = langid.fit(odd, F.lit(True))
    got = langid.identify(odd, model).collect()
    assert len(got) == 17 and {r.lang_pred for r in got if r.text is None} == {"und"}
    none = langid.fit(empty, F.lit(True))
    assert none.languages == [] and {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []


# 9. exact deduplication


def test_exact(tables):
    for df in tables.values():
        rows = rows_of(df)
        strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups = defaultdict(list)
        for d, t in rows:
            groups[strip(t)].append((-len(t or ""), d is None, d or 0, d))
        want = []
        for d, t in rows:
            g = groups[strip(t)]
            want.append((d, min(g)[3], len(g), hashlib.sha256(strip(t).encode()).hexdigest()))
        found = exact_dedup.exact_duplicates(df).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=key) == sorted(want, key=key)
        assert sum(r.kept for r in found) == len(groups) and all(r.doc_id == r.keep_id for r in found if r.kept)
        assert exact_dedup.keep_first(df).count() == len(groups)


def test_exact_in_batches(small):
    a = exact_dedup.exact_duplicates(small.repartition(5)).select("doc_id", "keep_id", "group_size", "kept").collect()
    b = exact_dedup.exact_duplicates(small.repartition(5), files_per_batch=1).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(a) == sorted(b)


def test_exact_state_across_batches(spark, tmp_path):
    rows = [(i, "same  text" if i % 2 else f"text {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = f"file://{tmp_path}/state"
    got = exact_dedup.exact_duplicates(df, folder=folder).collect()
    assert {r.group_size for r in got if r.doc_id % 2} == {6} and sum(r.kept for r in got) == 7
    states = spark.read.parquet(f"{folder}/states")
    hot = states.groupBy("digest").agg(F.count("*").alias("n"), F.max("group_size").alias("m")).where("m = 6").first()
    assert states.select("batch").distinct().count() >= 3 and hot.n >= 2  # later batches hit what earlier ones left in the state


def test_exact_resumes(spark, small, tmp_path, monkeypatch):
    df = small.repartition(8)
    want = sorted(map(tuple, exact_dedup.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect()))
    df.write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    folder, calls, save = f"file://{tmp_path}/resume", [], exact_dedup.save_states

    def failing(batch, number, path):
        calls.append(number)
        if number == 2 and len(calls) == 3:
            raise RuntimeError("stopped")
        save(batch, number, path)

    monkeypatch.setattr(exact_dedup, "save_states", failing)
    with pytest.raises(Exception, match="stopped"):
        exact_dedup.exact_duplicates(df, folder=folder)
    assert calls == [0, 1, 2]
    got = exact_dedup.exact_duplicates(df, folder=folder)
    assert calls[3] == 2 and min(calls[3:]) == 2  # the finished batches weren't run again
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept").collect())) == want


def test_exact_clashing_names(odd):
    clash = odd.withColumns({n: F.lit("mine") for n in ("_file", "_row", "file", "row", "digest", "rank", "kept", "group_size")})
    kept = exact_dedup.keep_first(clash)
    assert kept.columns == clash.columns and {r["_file"] + r["_row"] + r["kept"] for r in kept.collect()} == {"minemineminemine"[:12]}
    near = simhash.keep_one(clash)
    assert near.columns == clash.columns and {r["_file"] + r["_row"] for r in near.collect()} == {"minemine"}


def test_exact_empty(empty):
    assert exact_dedup.exact_duplicates(empty).collect() == []


# 10. toxicity


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grades = toxicity.label_grades(labels)
    model = toxicity.fit(docs, grades.where(crc_fold(F.col("doc_id"), 4) != 2), 3)
    held = docs.join(labels.where(crc_fold(F.col("doc_id"), 4) == 2).withColumnRenamed("toxic", "t"), "doc_id")
    got = toxicity.severity(held, model).join(held.select("doc_id", "t"), "doc_id")
    said = F.col("toxic").cast("int")
    hit, wrong = got.agg(F.avg(F.when(F.col("t") == 1, said)), F.avg(F.when(F.col("t") == 0, said))).first()
    assert hit > 0.9 and wrong < 0.02
    assert got.where("p_above[0] < p_above[1] or expected_severity < 0 or expected_severity > 2").count() == 0


def test_toxicity_brute():
    """The fit against a plain likelihood: slopes are zero there by finite differences, and no small step helps."""
    rng = np.random.default_rng(21)
    n, words = 400, 12
    x = rng.random((n, words)) < 0.3
    truth = np.array([3.0, -3.0, 2.0, *np.zeros(words - 3)])
    margin = (x * truth).sum(axis=1) / np.sqrt(np.maximum((x & (truth != 0)).sum(axis=1), 1)) + rng.logistic(size=n)
    grades = (margin > 0.5).astype(np.int64) + (margin > 2)
    flat, sizes = np.concatenate([np.flatnonzero(r) for r in x]), x.sum(axis=1)
    model = toxicity.fit_ordinal(flat, sizes, grades, 3, epochs=3000)
    kept = np.flatnonzero(model.weights)
    assert set(kept) >= {0, 1} and len(kept) <= 4

    def objective(w, b):
        total = 0.0
        for row, g in zip(x, grades, strict=True):
            have = [j for j in kept if row[j]]
            m = sum(w[j] for j in have) / max(1, len(have)) ** 0.5
            s = [1.0, *(1 / (1 + math.exp(c - m)) for c in b), 0.0]
            total += math.log(s[g] - s[g + 1])
        return total - 0.05 * sum(w[j] ** 2 for j in kept)

    w, b = dict(zip(kept.tolist(), model.weights[kept].tolist(), strict=True)), model.cuts.tolist()
    best = objective(w, b)
    for j in [*kept.tolist(), -1, -2]:
        for step in (1e-3, -1e-3):
            w2, b2 = dict(w), list(b)
            if j < 0:
                b2[j] += step
            else:
                w2[j] += step
            slope = (objective(w2, b2) - best) / step
            assert abs(slope) < 0.15 and objective(w2, b2) <= best + 1e-4


def test_toxicity_grades_by_hand(spark):
    weights = np.zeros(toxicity.DIMENSIONS)
    bad, awful = toxicity.features(b"bad"), toxicity.features(b"awful")
    weights[bad], weights[awful] = 2.0, 0.5
    df = spark.createDataFrame([(1, "bad"), (2, "good"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.severity(df, toxicity.Ordinal(weights, np.array([0.5, 1.5]))).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for i, m in ((1, 2.0 * len(bad) / len(bad) ** 0.5), (2, 0.0), (3, 0.0), (4, 0.0)):
        p = [sigmoid(m - 0.5), sigmoid(m - 1.5)]
        each = [1 - p[0], p[0] - p[1], p[1]]
        assert got[i].p_above == pytest.approx(p) and got[i].expected_severity == pytest.approx(sum(p))
        assert got[i].grade == each.index(max(each)) and got[i].toxic == (p[0] >= toxicity.CUT)


def test_toxicity_long_documents(spark):
    """All features of a long document take part in the fit, as in scoring; the sample's bound takes whole documents."""
    rng = np.random.default_rng(2)
    filler = " ".join(f"f{i}" for i in range(9_000))
    rows = [(i, f"{filler if i % 3 == 0 else 'short'} {'vile' if i % 2 else 'kind'} n{rng.integers(50)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, grade int")
    assert len(toxicity.features(rows[0][1].encode())) > 4_000
    model = toxicity.fit(docs, grades, 2)
    assert (model.weights[toxicity.features(b"vile")] > 0).any()
    got = toxicity.severity(docs, model, 0.5).collect()
    assert all(r.toxic == bool(r.doc_id % 2) for r in got)
    few = toxicity.fit(docs, grades, 2, sample_features=1_000_000)
    assert (few.weights == toxicity.fit(docs, grades, 2, sample_features=1_000_000).weights).all() and few.weights.any()


def test_toxicity_odd(odd, empty, spark):
    grades = spark.createDataFrame([(1, 0), (2, 1), (7, 2), (None, 1), (4, None)], "doc_id long, grade int")
    model = toxicity.fit(odd, grades, 3)
    assert toxicity.severity(odd, model).count() == 17
    assert toxicity.severity(empty, model).collect() == []
    blank = toxicity.fit(empty, grades, 3)
    assert not blank.weights.any() and toxicity.severity(odd, blank).count() == 17


# the pipeline


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.limit(20).withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("text", F.concat(F.lit(" "), "text"))
    docs.unionByName(copies).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.count()
        if name != "packed":
            assert now.columns == before.columns and now.dtypes == before.dtypes
    assert seen["language"] >= 0.99 * (docs.count() + 20)
    assert seen["exact"] <= seen["language"] - 20 and seen["near"] <= seen["exact"]
    assert now.select("doc_id").distinct().count() == seen["passages"]
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    # the copy has one more character and goes before its original, unless it is dropped as the copy of another
    assert not any(r.doc_id in ids and r.doc_id - 1_000_000 in ids for r in copies.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def _near_classes(texts, k=5):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(sets[a] & sets[b])
        if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(sets))]


def test_pipeline_rows(spark, small, odd, tokenizer, tmp_path):
    """The rows of every stage against a plain version of it on the same input, odd rows included."""
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
    now, stages = small.unionByName(odd.select(*[F.col(c).cast(t) for c, t in small.dtypes])), dict(corpus_pipeline.STAGES)

    def step(name):
        before = rows_of(now)
        stages[name](spark, now, "").write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        return before, after

    before, now = step("language")
    model = langid.fit(small.unionByName(odd.select(*[F.col(c).cast(t) for c, t in small.dtypes])), F.lit(True))
    kept = []
    for d, t in before:
        ce, size = langid.cross_entropy(model, [(t or "").encode()])
        best = int(ce[0].argmin())
        if any(ch.isalpha() for ch in t or "") and not (size[0] >= 20 and ce[0, best] > model.limits[best]):
            kept.append((d, t))
    assert order(rows_of(now)) == order(kept) and 0 < len(kept) < len(before)

    before, now = step("exact")
    groups = defaultdict(list)
    for d, t in before:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d, t))
    assert order(rows_of(now)) == order([min(g)[3:] for g in groups.values()])

    before, now = step("near")
    classes = defaultdict(list)
    for (d, t), root in zip(before, _near_classes([t for _, t in before]), strict=True):
        classes[root].append((d is None, d or 0, d, t))
    assert order(rows_of(now)) == order([min(c)[2:] for c in classes.values()])

    before, now = step("passages")
    want = []
    for (d, t), (_, n, gone, text) in zip(before, brute_spans(before, 50), strict=True):
        if gone < n or not gone:
            want.append((d, text if gone else t))
    assert order(rows_of(now)) == order(want)

    before, now = step("packed")
    want = []
    for d, t in before:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(d, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in itertools.pairwise(cut)]
    got = now.collect()
    assert order([(r.doc_id, r.start, r.length, r.ids_crc32) for r in got]) == order(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(p)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(p))) and sum(max(p)) <= 2048 for p in seqs.values())


def test_pipeline_odd(spark, odd, empty, tmp_path):
    for k, df in enumerate((odd, empty)):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, "").write.parquet(str(tmp_path / f"{k}{name}"))
            now = spark.read.parquet(str(tmp_path / f"{k}{name}"))


def test_registered():
    names = queries.queries()
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
