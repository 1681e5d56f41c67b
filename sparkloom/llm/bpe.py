"""Byte-level BPE with content-defined chunk reuse.

Documents are cut by a rolling hash of their bytes. Chunks that occur more than once in the
corpus are encoded once; a document is put together from their stored ids and from the text
between them, whose joins are encoded again until both sides agree.

Where a join may end is decided by the pre-tokeniser's grammar: a pre-token never holds
white space behind another character, so a position between a character other than white
space and a space starts a pre-token in every context. Such a position is called firm here.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Work, arrow_schema, blocks, bloom_bits, bloom_hits, shared, unused, utf8_bytes

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Entries of a worker's table of encoded words; at this number the table starts again.
CACHE_WORDS = 400_000
#: Rolling hash: window of 32 bytes; a cut where its low bits are zero, so chunks of 1,024 bytes on average.
CHUNK_BITS, CHUNK_MIN = 10, 256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encodes as tokenizers does with the byte_bpe_50k vocabulary, to little-endian 32-bit ids.

    Text is taken apart at firm positions; each distinct part is encoded once a worker by the
    same vocabulary's ranks, and a document is a join of such parts.
    """

    def __init__(self, ranks: str, cache_words: int = CACHE_WORDS) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.pieces = [b""] * (SPECIAL_ID + 1)
        for piece, i in table.items():
            self.pieces[i] = piece
        self.pieces[SPECIAL_ID] = SPECIAL.encode()
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        """Encodes text without the special token."""
        if not text:
            return b""
        if _LOOSE(text):
            return b"".join(self._known(self.first, u, "") for u in _FIRM(text))
        head, *words = text.split(" ")
        out = [self._known(self.first, head, "")] if head else []
        get = self.rest.get
        for w in words:
            out.append(get(w) or self._known(self.rest, w, " "))
        return b"".join(out)

    def _known(self, table: dict[str, bytes], word: str, lead: str) -> bytes:
        ids = table.get(word)
        if ids is None:
            ids = self._ids(lead + word)
            if len(word) <= 64:
                if len(self.first) + len(self.rest) >= self.cache_words:
                    self.first.clear()
                    self.rest.clear()
                table[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self._part(text)
        return np.array([SPECIAL_ID], "<u4").tobytes().join(self._part(p) for p in text.split(SPECIAL))

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


#: Finds a space behind white space or at the end: then single spaces don't part the text at firm positions only.
_LOOSE = re.compile(r"\s | \Z").search
_FIRM = re.compile(r"(?<=\S)(?= )").split


@lru_cache(maxsize=2)
def codec(ranks: str) -> Codec:
    return Codec(ranks)


_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def chunk_ends(data: bytes, bits: int = CHUNK_BITS, least: int = CHUNK_MIN) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 bytes; cuts fall between characters."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    array = np.frombuffer(data, np.uint8)
    h = _GEAR[array]
    for step in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
    found = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out, last = [], 0
    for end in found.tolist():
        while end < n and array[end] & 0xC0 == 0x80:
            end += 1
        if end - last >= least and end < n:
            out.append(end)
            last = end
    return [*out, n]


def firm_span(text: str) -> tuple[int, int]:
    """The first and the last firm position of a chunk; (-1, -1) if it has fewer than two."""
    m = _FIRST_FIRM(text)
    if not m:
        return -1, -1
    place = len(text)
    while (place := text.rfind(" ", 1, place)) > 0:
        if not text[place - 1].isspace():
            return (m.start(), place) if place > m.start() else (-1, -1)
    return -1, -1


_FIRST_FIRM = re.compile(r"(?<=\S)(?= )").search


def chunk_record(c: Codec, data: bytes) -> tuple[int, int, bytes]:
    """(start, end, ids): what lies between a chunk's outer firm positions, in bytes, encoded. It holds in every context.

    A chunk with part of the special token at an end keeps that part outside: the token has no space.
    """
    text = data.decode()
    a, b = firm_span(text)
    if a < 0:
        return 0, 0, b""
    start = len(text[:a].encode())
    core = text[a:b]
    return start, start + len(core.encode()), c.encode(core)


def assemble(c: Codec, data: bytes, ends: list[int], known: dict[int, tuple[int, int, bytes]]) -> bytes:
    """A document's ids from stored chunks and what is encoded here.

    Each join covers the text from the last firm position before it to the first one after it.
    It is encoded together with the stored chunk's next word; if the ids that follow the join
    aren't the chunk's own first ids, the join is widened over the chunk and encoded again.
    """
    out, done, start = [], 0, 0
    for n, end in enumerate(ends):
        rec = known.get(n)
        if rec is not None and rec[1] > rec[0]:
            a, b, ids = start + rec[0], start + rec[1], rec[2]
            word = data.find(b" ", a + 1, b)
            guard = word if word > 0 and not data[a:word].isspace() and not data[word - 1 : word].isspace() and data[word - 1] < 128 else b
            tail = c.encode(data[a:guard].decode())
            joined = c.encode(data[done:guard].decode())
            if ids.startswith(tail) and joined.endswith(tail):
                out += [joined[: len(joined) - len(tail)], ids]
                done = b
        start = end
    out.append(c.encode(data[done:].decode()))
    return b"".join(out)


_KEY = pa.binary(16)


def _key(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _low(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8")[::2] if keys else np.zeros(0, np.uint64)


def encode_documents(
    docs: DataFrame, ranks: str | None = None, text: str = "text", bits: int = CHUNK_BITS, ids: bool = False, keep_text: bool = True
) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256, n_chunks, n_reused (and ids, little-endian 32-bit) to every row.

    Null text counts as empty: no ids, digests of nothing. Bytes that aren't UTF-8 count as replacement characters. Repeated rows get equal values. No row
    is dropped, an empty table gives an empty one. Other columns are carried along; columns
    with an added column's name are replaced.

    Scans: 1. count chunks; 2. encode those that occur twice or more, once; 3. put documents
    together. Only documents that may hold a shared chunk are shuffled, by their text's digest.
    """
    spark, ranks = docs.sparkSession, ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    work = Work(spark, "bpe")
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks int, n_reused int" + ", ids binary" * ids
    names = [x.split()[0] for x in added.split(", ")]
    docs = docs.drop(*names)
    key_name, parts_name = unused(["_text_key", "_parts"], [*docs.columns, *names])

    count_schema, count_arrow = arrow_schema("h binary, low long, n long")

    def count(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for data in utf8_bytes(batch.column(0)):
                start = 0
                for end in chunk_ends(data, bits):
                    k = _key(data[start:end])
                    seen[k] = seen.get(k, 0) + 1
                    start = end
            if len(seen) > 200_000:
                yield _counted(seen)
                seen = {}
        yield _counted(seen)

    def _counted(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(_low(keys).view(np.int64)), pa.array(list(seen.values()), pa.int64())], schema=count_arrow)

    common = docs.select(text).mapInArrow(count, count_schema).groupBy("h", "low").agg(F.sum("n").alias("n")).where("n > 1")
    common = work.table(common, "shared")
    filter_ = shared(spark, bloom_bits(common, "low"))

    chunk_schema, chunk_arrow = arrow_schema("h binary, chunk binary")

    def pick(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keys, chunks = [], []
            for data in utf8_bytes(batch.column(0)):
                ends = chunk_ends(data, bits)
                own = [_key(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                for n in np.flatnonzero(bloom_hits(filter_.value, _low(own))).tolist():
                    if own[n] not in seen:
                        seen.add(own[n])
                        keys.append(own[n])
                        chunks.append(data[ends[n - 1] if n else 0 : ends[n]])
            if len(seen) > 500_000:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(chunks, pa.binary())], schema=chunk_arrow)

    record_schema, record_arrow = arrow_schema("h binary, a int, b int, chunk_ids binary")

    def encode(batches):
        c = codec(ranks)
        for batch in batches:
            rows = [(h, *chunk_record(c, data)) for h, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(record_arrow)], schema=record_arrow)

    chunks = docs.select(text).mapInArrow(pick, chunk_schema).groupBy("h").agg(F.first("chunk").alias("chunk"))
    encoded = chunks.join(common.select("h"), "h", "left_semi").mapInArrow(encode, record_schema)
    encoded = work.table(encoded, "encoded")

    ref_schema, ref_arrow = arrow_schema(f"{key_name} binary, n int, h binary")

    def refer(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for data in utf8_bytes(batch.column(0)):
                ends = chunk_ends(data, bits)
                own = [_key(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                hits = np.flatnonzero(bloom_hits(filter_.value, _low(own))).tolist()
                if hits and (key := _key(data)) not in seen:
                    seen.add(key)
                    rows += [(key, n, own[n]) for n in hits]
            if len(seen) > 500_000:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(ref_arrow)], schema=ref_arrow)

    refs = work.table(docs.select(text).mapInArrow(refer, ref_schema).distinct(), "refs")
    parts = refs.join(encoded, "h").groupBy(key_name).agg(F.collect_list(F.struct("n", "a", "b", "chunk_ids")).alias(parts_name))
    parts = work.table(parts, "parts")

    base = [f for f in docs.schema.fields if keep_text or f.name != text]
    out_schema = arrow_schema(added)[0]
    full = type(docs.schema)([*base, *out_schema.fields])
    full_arrow = _to_arrow(full)

    def rows(with_parts: bool, keep_hits: bool | None):
        def run(batches):
            c = codec(ranks)
            for batch in batches:
                batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
                texts = utf8_bytes(batch.column(names_at))
                if keep_hits is not None:
                    mask = [False] * len(texts)
                    cut = []
                    for i, data in enumerate(texts):
                        ends = chunk_ends(data, bits)
                        own = [_key(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                        mask[i] = bool(bloom_hits(filter_.value, _low(own)).any()) == keep_hits
                        if mask[i]:
                            cut.append(ends)
                    batch = batch.filter(pa.array(mask))
                    texts = [t for t, m in zip(texts, mask, strict=True) if m]
                    if keep_hits:
                        yield batch.append_column(key_name, pa.array([_key(t) for t in texts], pa.binary()))
                        continue
                else:
                    cut = [chunk_ends(t, bits) for t in texts]
                found = batch.column(batch.schema.get_field_index(parts_name)).to_pylist() if with_parts else [None] * len(texts)
                for lo, hi in blocks([len(t) for t in texts], 8 << 20):
                    cols = [[] for _ in names]
                    for data, ends, have in zip(texts[lo:hi], cut[lo:hi], found[lo:hi], strict=True):
                        known = {p["n"]: (p["a"], p["b"], p["chunk_ids"]) for p in have or ()}
                        encoded_ids = assemble(c, data, ends, known)
                        values = (len(encoded_ids) // 4, hashlib.sha256(encoded_ids).hexdigest(), hashlib.sha256(c.decode(encoded_ids).encode()).hexdigest(), len(ends), len(known), encoded_ids)
                        for col, v in zip(cols, values, strict=False):
                            col.append(v)
                    kept = [batch.column(batch.schema.get_field_index(f.name)).slice(lo, hi - lo).cast(full_arrow.field(f.name).type) for f in base]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, full_arrow.field(k).type) for k, v in zip(names, cols, strict=True))], schema=full_arrow)

        return run

    names_at = docs.columns.index(text)
    alone = docs.mapInArrow(rows(False, False), full)
    keyed = type(docs.schema)([*docs.schema.fields, *arrow_schema(f"{key_name} binary")[0].fields])
    joined = docs.mapInArrow(rows(False, True), keyed).join(parts, key_name, "left").drop(key_name).select(*docs.columns, parts_name)
    return alone.unionByName(joined.mapInArrow(rows(True, None), full))


def _to_arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
