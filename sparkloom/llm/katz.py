"""Scoring texts with a Katz back-off model of word pairs.

Pairs of a word and the one before it have a Good-Turing discounted probability if they occur as
often as the cutoff or more; the mass that is left goes to all other words in proportion to the
unigram model, with a weight for each context that makes the sum exactly one. Unigrams are
(c + 1) / (N + V + 1), with one share for all unknown words.

The model is stored in tables partitioned by ranges of hashes: pairs with their counts, and words
with their counts and, as contexts, their weights. A bucket is one row of packed arrays. Pairs lie with
their second word, so that its count is at hand where weights are summed up; the pairs of words
that are a large share of all tokens are dealt over all buckets, their counts go along. There are as many
buckets as the text has BUCKET_TEXT bytes, so a bucket's size doesn't grow with the data.

Scoring: blocks of texts ask the tables for their distinct words and pairs. The recursion
p(w|u) = discounted if the pair is known, else weight(u) p(w) is evaluated for each token.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Work, Words, arrow_schema, blocks, mix, partitions, text_bytes

#: Pairs seen less often than CUTOFF count as unseen; counts up to MOST_DISCOUNTED are discounted.
CUTOFF, MOST_DISCOUNTED = 1, 5
#: Bytes of text for each bucket of the model, and of a block of texts that is scored at once.
BUCKET_TEXT, BLOCK_TEXT = 8 << 20, 8 << 20
#: Buckets are asked in so many rounds, so that not all questions are on disk at once.
ROUNDS = 2
#: Tokens that a task holds before it sums and sends them.
HELD_TOKENS = 3_000_000
#: A word with one part in so many of the tokens of a bucket is dealt over all buckets.
HEAVY_PART = 4
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the tokens of lower-cased texts, each text's end too; keys of the contexts; each text's first token."""
    words = Words(texts)
    out = np.full(len(words.doc) + len(texts), END, np.uint64)
    out[np.arange(len(words.doc)) + words.doc] = words.hashes()
    first = words.first[:-1] + np.arange(len(texts))
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first] = START
    return out, before, first


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _A + token * _B + np.uint64(1))


def discounts(n: dict[int, int], k: int = MOST_DISCOUNTED, cutoff: int = CUTOFF) -> dict[int, float]:
    """Katz's Good-Turing discount ratios of counts up to k, from counts of counts; 0 below the cutoff.

    Where the counts of counts allow none between 0 and 1 (small or odd data), (r - 0.5) / r.
    """
    out = {}
    tail = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        d = -1.0
        if n.get(r) and tail < 1:
            d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - tail) / (1 - tail)
        out[r] = 0.0 if r < cutoff else d if 0 < d < 1 else (r - 0.5) / r
    return out


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as packed differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key: equal ranges of keys, in order."""
    n, half = np.uint64(buckets), np.uint64(32)
    return ((keys >> half) * n + ((keys & np.uint64(0xFFFFFFFF)) * n >> half) >> half).astype(np.int32)


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and its place."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def pair_buckets(u: np.ndarray, w: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair: by its second word, by the whole pair if that word is a heavy one."""
    out = ranges(w, buckets)
    hit, _ = _member(heavy, w)
    out[hit] = ranges(pair_keys(u[hit], w[hit]), buckets)
    return out


def _pieces(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of rows that are sorted by bucket."""
    at = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0])).tolist() if len(bucket) else []
    return [(int(bucket[i]), i, j) for i, j in zip(at, [*at[1:], len(bucket)], strict=True)]


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _table(rows: list[tuple], arrow: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_rows(rows, arrow)])


@dataclass
class Katz:
    """pairs (bucket, a: second words, b: pairs of each, c: first words, d: counts), words (bucket, a: words, b: counts, c: weights, d: log10 of what a discounted count is divided by)."""

    pairs: DataFrame
    words: DataFrame
    buckets: int
    heavy: np.ndarray
    total: int
    vocabulary: int
    ratios: np.ndarray
    start: tuple[float, float]


def store_blocks(work: Work, docs: DataFrame, train) -> DataFrame:
    """block, ids, train, texts: all rows in blocks of about BLOCK_TEXT bytes, lower-cased, with one space between words."""
    schema, arrow = arrow_schema("block long, ids array<long>, train array<boolean>, texts binary")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, flags, texts, size = [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([ids], arrow.field(1).type), pa.array([flags], arrow.field(2).type), pa.array([zstandard.compress(b"\n".join(texts), 1)], pa.binary())], schema=arrow)

        for batch in batches:
            for doc, flag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                if texts and size + len(t) > BLOCK_TEXT:
                    yield block()
                    ids, flags, texts, size, number = [], [], [], 0, number + 1
                ids.append(doc)
                flags.append(bool(flag))
                texts.append(b" ".join(t.lower().split()))
                size += len(t)
        if texts:
            yield block()

    return work.table(docs.select(F.col("doc_id").cast("long"), train.cast("boolean"), "text").mapInArrow(run, schema), "blocks", codec="uncompressed")


def _texts(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b"\n")


def _held_tokens(batches):
    """The tokens and their contexts of the training texts of blocks, about HELD_TOKENS at a time."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for flags, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts = [t for t, f in zip(_texts(blob.as_py()), flags, strict=True) if f]
            for lo, hi in blocks([len(t) for t in texts]):
                token, before, _ = tokens(texts[lo:hi])
                held.append((token, before))
                size += len(token)
                if size > HELD_TOKENS:
                    yield tuple(np.concatenate([x[i] for x in held]) for i in (0, 1))
                    held, size = [], 0
    if size:
        yield tuple(np.concatenate([x[i] for x in held]) for i in (0, 1))


def count_words(work: Work, stored: DataFrame, buckets: int) -> DataFrame:
    """bucket, a (words), b (counts), size, total: every task sums its own words first."""
    schema, arrow = arrow_schema("bucket int, a binary, b binary")
    out, out_arrow = arrow_schema("bucket int, a binary, b binary, size long, total long")

    def run(batches):
        for token, _ in _held_tokens(batches):
            k, n = np.unique(token, return_counts=True)
            yield _rows([(b, _pack_keys(k[i:j]), _pack(n[i:j])) for b, i, j in _pieces(ranges(k, buckets))], arrow)

    def add(key, table):
        k, n = np.concatenate([_unpack_keys(x) for x in table.column("a").to_pylist()]), np.concatenate([_unpack(x, np.int64) for x in table.column("b").to_pylist()])
        k, at = np.unique(k, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        return _table([(key[0].as_py(), _pack_keys(k), _pack(n), len(k), int(n.sum()))], out_arrow)

    return work.table(stored.select("train", "texts").mapInArrow(run, schema).groupBy("bucket").applyInArrow(add, out), "counts")


def heavy_words(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that occur more than least times, in order, and their counts; the caller bounds their number by least."""

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, n = _unpack_keys(a), _unpack(b, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k[n > least].view(np.int64)), pa.array(n[n > least])], names=["w", "n"])

    found = counts.select("a", "b").mapInArrow(run, "w long, n long").toArrow()
    w, n = found.column("w").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(w)
    return w[order], n[order]


def count_pairs(work: Work, stored: DataFrame, heavy: np.ndarray, heavy_counts: np.ndarray, buckets: int, cutoff: int) -> DataFrame:
    """kind, bucket, a, b, c, d: kind 1 pairs from the cutoff on, 2 what contexts have in a bucket, 3 counts of pair counts."""
    schema, arrow = arrow_schema("bucket int, a binary, b binary, c binary, d binary")
    out, out_arrow = arrow_schema("kind int, bucket int, a binary, b binary, c binary, d binary")

    def run(batches):
        for w, u in _held_tokens(batches):
            bucket = pair_buckets(u, w, heavy, buckets)
            order = np.lexsort((u, w, bucket))
            u, w, bucket = u[order], w[order], bucket[order]
            new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
            n = np.diff(np.append(new, len(u)))
            u, w, bucket = u[new], w[new], bucket[new]
            yield _rows([(b, *packed(w[i:j], u[i:j], n[i:j])) for b, i, j in _pieces(bucket)], arrow)

    def packed(w, u, n):
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        return _pack_keys(w[at]), _pack(np.diff(np.append(at, len(w))).astype(np.uint32)), u.tobytes(), _pack(n.astype(np.uint32))

    def add(key, table):
        w, u, n = (np.concatenate(x) for x in zip(*(_pairs(*row) for row in zip(*(table.column(c).to_pylist() for c in "abcd"), strict=True)), strict=True))
        order = np.lexsort((u, w))
        w, u, n = w[order], u[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        w, u, n = w[new], u[new], np.add.reduceat(n, new)
        # the count of each pair's second word: all its pairs are here, but for the heavy ones
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        count = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(w))))
        hit, place = _member(heavy, w)
        count[hit] = heavy_counts[place[hit]]
        known = n >= cutoff
        rows = [(1, key[0].as_py(), *packed(w[known], u[known], n[known]))] if known.any() else []
        of_count = np.bincount(np.minimum(n, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2]
        rows.append((3, 0, of_count.tobytes(), b"", b"", b""))
        contexts, who = np.unique(u, return_inverse=True)
        few = n <= MOST_DISCOUNTED
        kinds = np.bincount(who[few] * MOST_DISCOUNTED + n[few] - 1, minlength=len(contexts) * MOST_DISCOUNTED).astype(np.uint32)
        rest = np.bincount(who[~few], n[~few], minlength=len(contexts)).astype(np.int64)
        mass = np.zeros(len(contexts), np.int64)
        np.add.at(mass, who[known], count[known] + 1)
        kinds = kinds.reshape(-1, MOST_DISCOUNTED)
        rows += [(2, b, _pack_keys(contexts[i:j]), _pack(kinds[i:j]), _pack(rest[i:j]), _pack(mass[i:j])) for b, i, j in _pieces(ranges(contexts, buckets))]
        return _table(rows, out_arrow)

    made = stored.select("train", "texts").mapInArrow(run, schema).groupBy("bucket").applyInArrow(add, out)
    return work.table(made, "model", codec="uncompressed", by="kind")


def _pairs(a: bytes, b: bytes, c: bytes, d: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second words, first words and counts of packed pairs."""
    return np.repeat(_unpack_keys(a), _unpack(b, np.uint32)), np.frombuffer(c, np.uint64), _unpack(d, np.uint32)


def weigh(work: Work, counts: DataFrame, partial: DataFrame, ratios: np.ndarray, all_: float) -> DataFrame:
    """kind, bucket, a, b, c, d: the words with counts and weights (kind 0), and the start of a text as a context (kind 1)."""
    out, out_arrow = arrow_schema("kind int, bucket int, a binary, b binary, c binary, d binary")
    r = np.arange(1, MOST_DISCOUNTED + 1)

    def run(key, partial, counts):
        cat = lambda f: np.concatenate([np.zeros(0, np.int64), *f])
        words = np.concatenate([np.zeros(0, np.uint64), *(_unpack_keys(x) for x in counts.column("a").to_pylist())])
        n = cat(_unpack(x, np.int64) for x in counts.column("b").to_pylist())
        u, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_unpack_keys(x) for x in partial.column("a").to_pylist())]), return_inverse=True)
        kinds = np.zeros((len(u), MOST_DISCOUNTED), np.int64)
        np.add.at(kinds, at, cat(_unpack(x, np.uint32).astype(np.int64) for x in partial.column("b").to_pylist()).reshape(-1, MOST_DISCOUNTED))
        rest, mass = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        np.add.at(rest, at, cat(_unpack(x, np.int64) for x in partial.column("c").to_pylist()))
        np.add.at(mass, at, cat(_unpack(x, np.int64) for x in partial.column("d").to_pylist()))
        c, kept = (kinds * r).sum(axis=1) + rest, (kinds * r) @ ratios[1 : MOST_DISCOUNTED + 1] + rest
        # a context without any mass left gives up one count
        held = np.where(kept > c - 1e-9, c / (c + 1), 1.0)
        own = np.log10(held / c)
        alpha = np.log10((1 - kept * held / c) / (1 - mass / all_))
        hit, place = _member(words, u)
        weights, units = np.zeros(len(words)), np.zeros(len(words))
        weights[place[hit]], units[place[hit]] = alpha[hit], own[hit]
        rows = [(0, key[0].as_py(), _pack_keys(words), _pack(n), _pack(weights), _pack(units))]
        start = np.flatnonzero(u == START)
        rows += [(1, key[0].as_py(), b"", b"", alpha[start].tobytes(), own[start].tobytes())] if len(start) else []
        return _table(rows, out_arrow)

    made = partial.groupBy("bucket").cogroup(counts.select("bucket", "a", "b").groupBy("bucket")).applyInArrow(run, out)
    return work.table(made, "words", codec="uncompressed", by="kind")


def fit(work: Work, stored: DataFrame, buckets: int, cutoff: int = CUTOFF) -> Katz:
    """The model of the training texts of stored blocks."""
    counts = count_words(work, stored, buckets)
    vocabulary, total = counts.agg(F.sum("size"), F.sum("total")).first()
    vocabulary, total = vocabulary or 0, total or 0
    # fewer than HEAVY_PART words for each bucket can be as frequent
    heavy, heavy_counts = heavy_words(counts, max(1, total // (HEAVY_PART * buckets)))
    model = count_pairs(work, stored, heavy, heavy_counts, buckets, cutoff)

    def unpacked(batches):
        for batch in batches:
            for a in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(range(1, MOST_DISCOUNTED + 2), pa.int64()), pa.array(np.frombuffer(a, np.int64))], names=["r", "n"])

    of_counts = model.where("kind = 3").select("a").mapInArrow(unpacked, "r long, n long").groupBy("r").agg(F.sum("n"))
    d = discounts({r[0]: r[1] for r in of_counts.collect()}, cutoff=cutoff)
    ratios = np.array([1.0, *(d[r] for r in range(1, MOST_DISCOUNTED + 1)), 1.0])
    words = weigh(work, counts, model.where("kind = 2"), ratios, float(total + vocabulary + 1))
    start = words.where("kind = 1").first()
    start = tuple(float(np.frombuffer(start[c])[0]) for c in "cd") if start else (0.0, 0.0)
    work.drop("counts", "model/kind=2", "model/kind=3")
    return Katz(model.where("kind = 1"), words.where("kind = 0"), buckets, heavy, total, vocabulary, ratios, start)


def asked(texts: list[bytes], heavy: np.ndarray, buckets: int):
    """What a block's texts ask for: (words, pairs, each as (keys, bucket) sorted by bucket and key; each token's word, context and pair among those, first tokens)."""
    parts = [tokens(texts[lo:hi]) for lo, hi in blocks([len(t) for t in texts])]
    sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
    token, before = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    first = np.concatenate([p[2] + at for p, at in zip(parts, sizes, strict=False)])
    words, word = np.unique(token, return_inverse=True)
    # a pair by its words' places in the block: shorter keys than the words' hashes
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first] = len(words)
    code, pair = np.unique(context * (len(words) + 1) + word, return_inverse=True)
    u = np.append(words, START)[code // (len(words) + 1)]
    w = words[code % (len(words) + 1)]
    keys, bucket = pair_keys(u, w), pair_buckets(u, w, heavy, buckets)
    order = np.lexsort((keys, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return (words, ranges(words, buckets)), (keys[order], bucket[order]), word, context, place[pair], first


def score(work: Work, stored: DataFrame, model: Katz) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of all rows of stored blocks."""
    buckets, heavy, ratios = model.buckets, model.heavy, model.ratios
    ask_schema, ask_arrow = arrow_schema("kind int, bucket int, block long, keys binary")

    def ask(turn: int):
        def run(batches):
            for batch in batches:
                for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words, pairs, *_ = asked(_texts(blob.as_py()), heavy, buckets)
                    yield _rows([(kind, b, block, _pack_keys(k[i:j])) for kind, (k, bucket) in enumerate((words, pairs)) for b, i, j in _pieces(bucket) if b % ROUNDS == turn], ask_arrow)

        return run

    answer_schema, answer_arrow = arrow_schema("block long, kind int, bucket int, a binary, b binary, c binary")

    def answer(key, questions, table):
        kind, bucket = key[0].as_py(), key[1].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in "abcd"), strict=True))
        if kind == 0:
            keys = _unpack_keys(rows[0][0]) if rows else np.zeros(0, np.uint64)
            values = [_unpack(x, t) for x, t in zip(rows[0][1:], (np.int64, np.float64, np.float64), strict=True)] if rows else []
        else:
            w, u, n = _pairs(*rows[0]) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
            keys = pair_keys(u, w)
            order = np.argsort(keys)
            keys, values = keys[order], [n[order]]
        out = []
        for block, blob in zip(questions.column("block"), questions.column("keys"), strict=True):
            hit, at = _member(keys, _unpack_keys(blob.as_py()))
            out.append((block.as_py(), kind, bucket, *(_pack(np.where(hit, v[at], 0).astype(v.dtype)) if len(keys) else _pack(np.zeros(len(at), t)) for v, t in zip(values or [None] * 3, (np.int64, np.float64, np.float64) if kind == 0 else (np.uint32,), strict=False))))
        return _table([(*r, *(b"" for _ in range(6 - len(r)))) for r in out], answer_arrow)

    columns = ["bucket", "a", "b", "c", "d"]
    entries = model.words.select(F.lit(0).alias("kind"), *columns).union(model.pairs.select(F.lit(1).alias("kind"), *columns))
    answers = None
    for turn in range(ROUNDS):
        questions = stored.select("block", "texts").mapInArrow(ask(turn), ask_schema)
        own = entries.where(F.col("bucket") % ROUNDS == turn)
        part = questions.groupBy("kind", "bucket").cogroup(own.groupBy("kind", "bucket")).applyInArrow(answer, answer_schema)
        part = work.table(part, f"answers{turn}", codec="uncompressed")  # packed already; the questions' shuffle files go
        answers = part if answers is None else answers.union(part)
    work.drop("model", "words")

    out, out_arrow = arrow_schema("doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    unit = math.log10(model.total + model.vocabulary + 1)
    start, total = model.start, model.total

    def evaluate(stored, answers):
        cols: list[list] = [[] for _ in out_arrow]
        got: dict[int, list] = {0: [], 1: []}
        for kind, bucket, *blobs in sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "a", "b", "c")), strict=True), key=lambda r: r[:2]):
            got[kind].append(blobs)
        cat = lambda kind, which, t: np.concatenate([np.zeros(0, t), *(_unpack(b[which], t) for b in got[kind])])
        for ids, blob in zip(stored.column("ids").to_pylist(), stored.column("texts").to_pylist(), strict=True):
            _, _, word, context, pair, first = asked(_texts(blob), heavy, buckets)
            c, alpha, own, n = cat(0, 0, np.int64), np.append(cat(0, 1, np.float64), start[0]), np.append(cat(0, 2, np.float64), start[1]), cat(1, 0, np.uint32)
            discounted = np.log10(np.maximum(n, 1) * ratios[np.minimum(n, MOST_DISCOUNTED + 1)])
            base = (np.log10(c + 1) - unit)[word]
            full = np.where((n > 0)[pair], discounted[pair] + own[context], base + alpha[context])
            sizes = np.diff(np.append(first, len(word)))
            for col, v in zip(cols, (ids, sizes.tolist(), np.add.reduceat((c > 0)[word].astype(np.int64), first).tolist(), [total] * len(ids), np.add.reduceat(base, first).tolist(), np.add.reduceat(full, first).tolist()), strict=True):
                col.extend(v)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cols, out_arrow, strict=True)], schema=out_arrow)

    return stored.select("block", "ids", "texts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(evaluate, out)


def katz_scores(docs: DataFrame, train, buckets: int | None = None, cutoff: int = CUTOFF) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    train selects the rows that the model learns from. Null texts are empty: the end token alone.
    Repeated rows get equal values and count as often as they occur. Without training rows
    N and V are 0 and every token is unknown. Pairs seen less often than cutoff count as unseen.
    """
    work = Work(docs.sparkSession, "katz")
    stored = store_blocks(work, docs, train)
    if not buckets:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(partitions(docs.sparkSession), -(-size // BUCKET_TEXT))
    return score(work, stored, fit(work, stored, buckets, cutoff))
