"""Sum-of-squares packing of documents into sequences of fixed length.

A sequence is open while it has room. With N(g) open sequences of gap g, a piece of length s
goes where the sum of N(g)**2 becomes smallest: into gap g it changes the sum by
2 * (N(g-s) - N(g)) + 2, into a new sequence by 2 * N(C-s) + 1. A piece that fills a gap
exactly takes one from N(g) only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import codec, tokenizer_path
from sparkloom.llm.common import Work, arrow_schema, utf8_bytes, unused

CAPACITY = 2048
#: Pieces that one task packs; what it leaves open goes to the next level.
SHARD_PIECES = 100_000
#: Levels after the first; a level that joins none ends them long before.
MOST_LEVELS = 4_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, in the order given; lengths are 1 to capacity.

    Ties go to the smallest gap, a new sequence last.
    """
    n_open = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 is closed and counts nothing
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    new = 0
    for i, s in enumerate(lengths.tolist()):
        here = n_open[s:capacity]  # gaps s to capacity - 1
        best = -1
        if len(here) and here.any():
            change = 2 * (n_open[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = 1 << 40
            at = int(change.argmin())
            if change[at] <= (2 * n_open[capacity - s] + 1 if s < capacity else 0):
                best = at + s
        if best < 0:
            b, best = new, capacity
            new += 1
        else:
            b = stacks[best].pop()
            n_open[best] -= 1
        bins[i], offsets[i] = b, capacity - best
        left = best - s
        if left:
            stacks[left].append(b)
            n_open[left] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document: its ids, then end_id.

    Longer documents than capacity are cut so that the first piece takes the remainder. Null text
    is empty: one piece with end_id alone. Bytes that aren't UTF-8 count as replacement characters. Rows with equal or null ids stay rows of their own.
    """
    ranks = ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    schema, arrow = arrow_schema("doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        c = codec(ranks)
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), utf8_bytes(batch.column(1)), strict=True):
                ids = c.encode(data.decode()) + end
                n, a, k = len(ids) // 4, 0, 0
                b = n % capacity or capacity
                while a < n:
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), part))
                    a, b, k = b, b + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _pack(capacity: int, level: int):
    """Packs the rows of one shard, the longest first, equal lengths by their turn; rows are pieces or partly filled sequences."""
    _, arrow = arrow_schema("item long, length long, bin long, place long, fill long")

    def run(shard, table):
        order = np.lexsort((table.column("item").to_numpy(), table.column("turn").to_numpy(), -table.column("length").to_numpy()))
        lengths, items = table.column("length").to_numpy()[order], table.column("item").to_numpy()[order]
        bins, places = sum_of_squares(lengths, capacity)
        fill = np.zeros(int(bins.max()) + 1 if len(bins) else 0, np.int64)
        np.add.at(fill, bins, lengths)
        base = (level << 51) + (int(shard[0].as_py()) << 24)  # 12 bits of level, 27 of shard, 24 of sequence
        return pa.Table.from_arrays([pa.array(items), pa.array(lengths), pa.array(bins + base), pa.array(places), pa.array(fill[bins])], schema=arrow)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity; sequences are gapless from 0.

    Shards of about shard_pieces rows (dealt by hash) are packed apart, the longest rows first;
    sequences that are not full and that another one could join are then packed together as if each
    were a piece, level by level, until one shard holds them all, none can be joined, or a level
    joined none. Columns named sequence_id or offset are replaced. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    work = Work(spark, "pack")
    schema = arrow_schema("item long, length long, bin long, place long, fill long")[0]
    pieces = pieces.drop("sequence_id", "offset")
    (number,) = unused(["_item"], pieces.columns)
    rows = work.table(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    total = rows.count()
    level, items = 0, rows.select(F.col(number).alias("item"), F.col(length).cast("long").alias("length"))
    moves = None  # sequence of the first level -> sequence so far, offset there; of those that later levels took up
    while True:
        shards = max(1, round(total / shard_pieces))
        dealt = items.withColumn("turn", F.xxhash64("item", F.lit(level))).withColumn("shard", F.pmod("turn", F.lit(shards)))
        done = dealt.withColumn("turn", F.xxhash64("turn")).groupBy("shard").applyInArrow(_pack(capacity, level), schema)
        done = work.table(done, f"level{level}")
        if level == 0:
            where = done.select(F.col("item").alias("_item"), F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
        else:
            step = done.select(F.col("item").alias("sequence_id"), F.col("bin").alias("to"), F.col("place").alias("by"))
            if moves is not None:  # what level 1 took up is all that later levels can move
                step = moves.join(step.select(F.col("sequence_id").alias("to"), F.col("to").alias("next"), F.col("by").alias("more")), "to", "left")
                step = step.select("sequence_id", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
            moves = work.table(step, f"moves{level}")
            if level > 1:
                work.drop(f"moves{level - 1}", f"level{level - 1}")
        if shards == 1 or level == MOST_LEVELS:
            break
        opened = done.where(F.col("fill") < capacity).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        least, joined = opened.agg(F.min("length")).first()[0], level == 0 or done.select("bin").distinct().count() < total
        if least is None or not joined:
            break
        opened = opened.where(F.col("length") + least <= capacity)
        left = opened.count()
        if left < 2:
            break
        level, items, total = level + 1, opened, left
    if moves is not None:
        joined_up = where.join(moves, "sequence_id", "left")
        where = joined_up.select("_item", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    placed = where.withColumnRenamed("_item", number)
    return rows.join(placed, number).drop(number)
