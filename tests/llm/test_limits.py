"""Limits that are rarely reached: few or very many languages, many levels, bytes that aren't UTF-8, clashing names."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, common, jaccard, langid, packing, simhash, substring, token_counts
from sparkloom.llm.common import Words, utf8_bytes


def test_one_document_a_language(spark):
    """Languages with a single document are learned, whatever the hash of its id."""
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "αβγδε", "жзийк", "𐐀𐐁𐐂𐐃𐐄"]
    rows = [(i, " ".join(x[j % 5] * 2 + x[(j + k) % 5] for j in range(9) for k in range(5)), f"l{i}") for i, x in enumerate(letters)]
    for start in (0, 100, 200):
        df = spark.createDataFrame([(i + start, t, x) for i, t, x in rows], "doc_id long, text string, lang string")
        model = langid.fit(df, F.lit(True))
        assert model.languages == sorted(x for _, _, x in rows)
        got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
        assert got == {i + start: x for i, _, x in rows}


def test_three_hundred_languages(spark):
    name = lambda i: chr(0x4E00 + i)
    rows = [(i, (name(i) + name(i + 400) + " ") * 20, f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df, F.lit(True))
    assert len(model.languages) == 300
    got = langid.identify(df, model).select("lang", "lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_far_characters():
    """Different letters beyond the basic plane have different classes; emoji are signs."""
    far = [langid._far_class(c) for c in range(0x10400, 0x10428)]
    assert len(set(far)) == len(far) and all(0xE000 <= c < 0xF900 for c in far)
    classes, _ = langid.characters(["🙂😀!".encode()])
    assert len(set(classes[-3:].tolist())) == 1


@pytest.mark.parametrize("shard", [2, 3])
def test_many_levels(spark, shard):
    """Small shards need many levels: pieces are placed without gaps and overlaps, and ids don't overflow."""
    lengths = [7 + i * 13 % 60 for i in range(700)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id int, length long")
    got = packing.pack(df, 100, shard).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 100
    assert len(by) < 1.4 * sum(lengths) / 100


def test_highest_level_is_a_long():
    highest = (packing.MOST_LEVELS << 51) + (((1 << 27) - 1) << 24) + (1 << 24) - 1
    assert highest < 1 << 63


@pytest.fixture(scope="module")
def bad(spark):
    return spark.range(3).select(F.col("id").alias("doc_id"), F.expr("case id when 0 then cast(x'6120ff20f09f62' as string) when 1 then 'a b' end").alias("text"))


def test_bytes_that_are_not_utf8(bad):
    text = b"a \xff \xf0\x9fb".decode("utf-8", "replace")
    c = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.tiktoken"))
    got = {r.doc_id: r for r in bpe.encode_documents(bad, keep_text=False).collect()}
    assert got[0].ids_sha256 == hashlib.sha256(c.encode(text)).hexdigest() and got[0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[2].n_tokens == 0
    assert {r.doc_id: r.length for r in packing.token_pieces(bad).collect()}[0] == len(c.encode(text)) // 4 + 1
    assert {r.doc_id: r.kept_text for r in substring.remove_repeats(bad).collect()}[0] == text
    assert token_counts.token_counts(bad).count() == 3


def test_utf8_bytes():
    import pyarrow as pa

    column = pa.array([b"a", None, b"\xff"], pa.binary()).view(pa.string())
    assert utf8_bytes(column) == [b"a", b"", "�".encode()]
    assert utf8_bytes(pa.array(["é", None])) == ["é".encode(), b""]


def test_encoding_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "some words here", "x", 5), (2, "some words here", "y", 6)], "doc_id long, text string, _text_key string, _parts int")
    got = bpe.encode_documents(df, bits=1)
    assert sorted((r.doc_id, r._text_key, r._parts) for r in got.collect()) == [(1, "x", 5), (2, "y", 6)]


def _peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _texts(n: int) -> list[bytes]:
    rng = np.random.default_rng(5)
    return [b" ".join(b"w%d" % x for x in rng.integers(0, 50_000, 300)) for _ in range(n)]


def test_words_take_bounded_memory(monkeypatch):
    """Kernels on words take memory by the block, not by the batch, one text or all passages of a shard; hashes are the same in pieces."""
    texts = _texts(2_000)  # 4 MB
    one = b" ".join(texts)
    for most, run in (
        (60, lambda: [None for _ in jaccard.shingle_sets(texts, 5)]),
        (130, lambda: [None for _ in jaccard.shingle_sets([one], 5)]),
        (60, lambda words=Words([one]): words.hashes()),
    ):
        assert _peak_mb(run) < most
    few = Words([one[:3_000], b"", one[3_000:9_000]])
    whole = few.hashes()
    sets = [(h.tolist(), names.tolist()) for _, _, h, _, names in jaccard.shingle_sets([one[:3_000], b"", b"a", one[3_000:9_000]], 5)]
    monkeypatch.setattr(common.byte_hashes, "__defaults__", (100,))
    assert (few.hashes() == whole).all()
    assert sets == [(h.tolist(), names.tolist()) for _, _, h, _, names in jaccard.shingle_sets([one[:3_000], b"", b"a", one[3_000:9_000]], 5)]


def test_passages_are_cut_in_blocks_of_words(monkeypatch):
    sizes = []

    class Seen(Words):
        def __init__(self, texts):
            sizes.append(sum(map(len, texts)))
            super().__init__(texts)

    monkeypatch.setattr(substring, "Words", Seen)
    n = 1_000
    schema = pa.schema([("a", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("skip", pa.int32()), ("words", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())] * 3 + [pa.array([0] * n, pa.int32())] * 2 + [pa.array(_texts(n), pa.binary())], schema=schema)
    out = list(substring.one_by_one([batch], 50))
    assert len(sizes) > 3 and max(sizes) <= 1 << 19 and sum(b.num_rows for b in out) == n * 251


def test_fingerprints_of_a_pattern_take_bounded_memory():
    """A pattern's variants are made and matched a few MB at a time, and links stay the same."""
    f = np.unique(np.random.default_rng(6).integers(0, 1 << 56, 20_000).astype(np.uint64))
    f = np.concatenate([f, f[:500] ^ np.uint64(9)])
    assert _peak_mb(lambda: simhash.link_pattern(f, 0, 4)) < 60
    got, want = (np.unique(simhash.link_pattern(f, 0, 4, block=n), axis=0) for n in (250_000, 2_000_000))
    assert len(want) == 500 and got.tolist() == want.tolist()
