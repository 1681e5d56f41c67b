"""Fill-in-middle transformation over a distinct-text index.

Texts that occur more than once are grouped by content. The list of a text's code point boundaries
is worked out once for each distinct text, as an Elias-Fano list, and joined back to the documents,
which select their two seeded cuts in it.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Work, arrow_schema, blocks, bloom_bits, bloom_hits, bloom_size, shared, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain at least, and of 100 others so many begin with the suffix.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Every so many-th boundary's place in the high bits is stored.
SAMPLE = 256
_HEAD = struct.Struct("<QQBI")


def boundary_list(data: bytes) -> bytes:
    """The Elias-Fano list of where the code points of UTF-8 bytes start.

    Low bits are stored as they are, high bits in unary, with samples of their places. In bytes that aren't
    UTF-8 a unit is any byte with the continuation bytes behind it.
    """
    array = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((array & 0xC0) != 0x80)
    if len(array) and (not len(starts) or starts[0]):
        starts = np.concatenate([[0], starts[1:]]) if len(starts) else np.zeros(1, np.int64)
    n, size = len(starts), len(array)
    low = max((size // n).bit_length() - 1, 0) if n else 0
    places = (starts >> low) + np.arange(n)
    high = np.zeros((size >> low) + n + 1, np.uint8)
    high[places] = 1
    lows = ((starts[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(n, size, low, len(samples)) + samples + np.packbits(lows, bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(index: bytes, k: int) -> int:
    """The byte at which code point k starts; the number of bytes if k is the number of code points."""
    n, size, low, sampled = _HEAD.unpack_from(index)
    if k >= n:
        return size
    lows_at = _HEAD.size + sampled
    high_at = lows_at + (n * low + 7) // 8
    (place,) = struct.unpack_from("<I", index, _HEAD.size + k // SAMPLE * 4)
    left = k % SAMPLE
    if left:  # the ones behind the sample; a unit of one to four bytes is some bits
        at, bits = place >> 3, np.zeros(0, np.uint8)
        end = at + 64
        while True:
            bits = np.unpackbits(np.frombuffer(index, np.uint8, min(end, len(index) - high_at) - at, high_at + at), bitorder="little")
            bits[: place & 7] = 0
            ones = np.flatnonzero(bits)
            if len(ones) > left:
                break
            end = at + 2 * (end - at)
        place = at * 8 + int(ones[left])
    rest = sum(((index[lows_at + ((k * low + b) >> 3)] >> ((k * low + b) & 7)) & 1) << b for b in range(low))
    return (place - k << low) | rest


def cuts(data: bytes, index: bytes, doc_id: int | None, seed: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, prefix_chars, middle_chars, output) of one document; a null id is an empty string in the seed's text."""
    (n,) = struct.unpack_from("<Q", index)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = struct.unpack_from(">IIII", digest)
    if not n or h3 % 100 >= PLAIN_FROM or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = select(index, a), select(index, b)
    prefix, middle, suffix = PREFIX.encode() + data[:i], MIDDLE.encode() + data[i:j], SUFFIX.encode() + data[j:]
    if h4 % 100 < SPM_BELOW:
        return "spm", a, b - a, suffix + prefix + middle
    return "psm", a, b - a, prefix + suffix + middle


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form: marks don't occur in a text that was cut."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(body, first, 1)
        rest = F.substr(body, F.length(a) + F.lit(len(first) + 1))
        b = F.substring_index(rest, second, 1)
        return a, b, F.substr(rest, F.length(b) + F.lit(len(second) + 1))

    prefix, suffix, middle = parts(SUFFIX, MIDDLE)
    suffix_, prefix_, middle_ = parts(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _cut_rows(ids: list, texts: list[bytes], indexes: list[bytes], seed: int, schema: pa.Schema) -> pa.RecordBatch:
    found = [cuts(*row, seed) for row in zip(texts, indexes, ids, strict=True)]
    columns = [ids, [_HEAD.unpack_from(x)[0] for x in indexes], *zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(t.type) if t.name == "output" else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    A null text is empty; an empty text, one with a mark in it and one in ten others stay plain, with null
    cuts. Rows with equal doc_id and text are cut alike; a null doc_id is an empty string in the seed's text.
    Bytes that aren't UTF-8 raise where the output becomes a string. An empty table gives an empty one.
    Other columns are not read.

    Texts whose digest occurs once are indexed and cut where they are read. The others are shuffled: each distinct
    text once for each task that has it, grouped by digest and whole content, and joined to its documents on both;
    Spark splits the documents of a text that has very many.
    """
    spark = docs.sparkSession
    work = Work(spark, "fim")
    out, out_arrow = arrow_schema(_OUT)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    keyed = docs.select("doc_id", text, F.unhex(F.sha2(text, 256)).alias("digest"))
    common = work.table(keyed.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("digest").alias("low")), "common")
    filter_ = shared(spark, bloom_bits(common, "low", bloom_size(common.count())))
    keyed = keyed.select("doc_id", "text", "digest", F.xxhash64("digest").alias("low"))

    def hit(batch: pa.RecordBatch) -> np.ndarray:
        return bloom_hits(filter_.value, batch.column(3).to_numpy().view(np.uint64))

    def alone(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~hit(batch)))
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for lo, hi in blocks([len(t) for t in texts]):
                yield _cut_rows(ids[lo:hi], texts[lo:hi], [boundary_list(t) for t in texts[lo:hi]], seed, out_arrow)

    several = keyed.mapInArrow(lambda batches: (b.filter(pa.array(hit(b))) for b in batches), keyed.schema).drop("low")

    index_schema, index_arrow = arrow_schema("digest binary, text string, boundaries binary")

    def build(batches):
        for batch in batches:
            lists = [boundary_list(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.string()), pa.array(lists, pa.binary())], schema=index_arrow)

    def cut(batches):
        for batch in batches:
            ids, texts, lists = batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()
            for lo, hi in blocks([len(t) for t in texts]):
                yield _cut_rows(ids[lo:hi], texts[lo:hi], lists[lo:hi], seed, out_arrow)

    # written, so that a task never holds the workers of two steps at once
    index = work.table(several.select("digest", "text").distinct().mapInArrow(build, index_schema), "index")
    joined = several.join(index, ["digest", "text"]).select("doc_id", "text", "boundaries")
    return keyed.mapInArrow(alone, out).unionByName(joined.mapInArrow(cut, out))
