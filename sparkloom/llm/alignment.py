"""Aligns two tokenisers by an event sweep.

The ends of both sides' tokens are events. They are shuffled by document, sorted by offset within
it, and streamed through a machine that holds no more than the open group: where both sides end, a group
closes; between two neighbouring ends lies one link, from the token of A to the token of B that cover it.

Events travel in windows of text: one row has the ids of all tokens of one side that end within
WINDOW bytes, as their ends follow from the ids. A document that fits one window is swept with others
in one piece of numpy; the rest goes window by window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import codec, tokenizer_path
from sparkloom.llm.common import Work, arrow_schema, located, text_bytes

#: Bytes of text in a window; entries of a worker's table of encoded words; bytes of text swept at a time.
WINDOW, CACHE_WORDS, SWEEP_BYTES = 32 << 10, 300_000, 1 << 20
#: Pairs of ids whose counts are broadcast at most (some 64 MB); more are joined by shuffling.
MOST_PAIRS = 1 << 20
_UNIT = re.compile(" +[^ ]*").findall


class PieceCodec:
    """Ids of a sentencepiece BPE model without special tokens, as it gives them for the text.

    No piece of the model has a space behind another character, so a run of spaces with what follows it is
    encoded for itself, once a worker.
    """

    def __init__(self, model: str, cache_words: int = CACHE_WORDS) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("a piece has a space behind another character")
        self.pieces = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.space = self.model.piece_to_id("▁")
        self.known: dict[str, bytes | None] = {}
        self.cache_words = cache_words

    def _unit(self, unit: str) -> bytes | None:
        ids = self.model.encode(unit[1:]) if len(unit) > 1 else [self.space]
        same = b"".join(self.pieces[i] for i in ids) == unit.encode()
        out = np.array(ids, "<u2").tobytes() if same else None
        if len(unit) <= 64:
            if len(self.known) >= self.cache_words:
                self.known.clear()
            self.known[unit] = out
        return out

    def encode(self, spaced: str) -> bytes | None:
        """16-bit ids of the text without its leading space; None if the pieces' bytes aren't those of the spaced text."""
        out, known = [], self.known
        for unit in _UNIT(spaced):
            ids = known[unit] if unit in known else self._unit(unit)
            if ids is None:
                return None
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def piece_codec(model: str) -> PieceCodec:
    return PieceCodec(model)


class Sweep:
    """The machine: takes a document's ids of both sides window by window; holds the open group, counts and a running digest."""

    def __init__(self, lengths_a: np.ndarray, lengths_b: np.ndarray, names: list[list[bytes]]) -> None:
        self.lengths, self.names = (lengths_a, lengths_b), names

    def start(self) -> None:
        self.open = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]
        self.n = [0, 0, 0, 0]
        self.digest = hashlib.sha256()
        self.pairs: dict[int, int] = {}

    def feed(self, a: np.ndarray, b: np.ndarray, last: bool) -> None:
        """One window's tokens; after the last window both sides end together."""
        sides = [np.concatenate([o, x]) for o, x in zip(self.open, (a, b), strict=True)]
        ends = [np.cumsum(w[x], dtype=np.int64) for w, x in zip(self.lengths, sides, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        cut = [np.searchsorted(e, common[-1], "right") if len(common) else 0 for e in ends]
        self.open = [x[k:] for x, k in zip(sides, cut, strict=True)]
        if len(common):
            found = self.whole([x[:k] for x, k in zip(sides, cut, strict=True)], np.array([common[-1]]))[0]
            self.n = [x + y for x, y in zip(self.n, found[:4], strict=True)]
            if self.n[2] > found[2]:
                self.digest.update(b";")
            self.digest.update(found[4])
            for p, k in zip(found[5].tolist(), found[6].tolist(), strict=True):
                self.pairs[p] = self.pairs.get(p, 0) + k
        if last and any(map(len, self.open)):
            raise ValueError("the sides don't end together")

    def end(self) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts of pairs."""
        return (*self.n, self.digest.hexdigest(), list(self.pairs), list(self.pairs.values()))

    def whole(self, sides: list[np.ndarray], sizes: np.ndarray) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, text of the groups, pairs, their counts) of whole documents, laid end to end."""
        a, b = sides
        stop = np.cumsum(sizes)
        is_a, is_b = np.zeros(stop[-1] + 1, bool), np.zeros(stop[-1] + 1, bool)
        end_a, end_b = np.cumsum(self.lengths[0][a], dtype=np.int64), np.cumsum(self.lengths[1][b], dtype=np.int64)
        is_a[end_a], is_b[end_b] = True, True
        ends = np.flatnonzero(is_a | is_b)
        on_a, on_b = is_a[ends], is_b[ends]
        at_a, at_b = np.cumsum(on_a) - on_a, np.cumsum(on_b) - on_b  # the token that covers what lies before an end
        pair = a[at_a].astype(np.int64) << 16 | b[at_b]
        links = np.searchsorted(ends, stop, "right")
        group = np.flatnonzero(on_a & on_b)
        groups = np.searchsorted(ends[group], stop, "right")
        tokens_a, tokens_b = np.searchsorted(end_a, stop, "right"), np.searchsorted(end_b, stop, "right")
        # groups as text: within a group the tokens of A, then those of B; each with the sign behind it
        after_a, after_b = at_a[group] + 1, at_b[group] + 1
        place_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], after_b[:-1]]), np.diff(after_a, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(after_a, np.diff(after_b, prepend=0))
        text = np.empty(len(a) + len(b), np.int64)
        text[place_a], text[place_b] = a.astype(np.int64) * 3, b.astype(np.int64) * 3
        text[place_a[after_a - 1]] += 1
        text[place_b[after_b - 1]] += 2
        names, text = self.names, text.tolist()
        # distinct pairs of each document with their counts
        key = np.repeat(np.arange(len(stop)), np.diff(links, prepend=0)) << 32 | pair
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(first, append=len(key)).astype(np.int32)
        key = key[first]
        own = np.searchsorted(key >> 32, np.arange(len(stop) + 1))
        pair = key & 0xFFFFFFFF
        out, before = [], (0, 0, 0, 0)
        for d, now in enumerate(zip(tokens_a.tolist(), tokens_b.tolist(), groups.tolist(), links.tolist(), strict=True)):
            shown = b"".join([names[i] for i in text[before[0] + before[1] : now[0] + now[1]]])[:-1]
            out.append((*(x - y for x, y in zip(now, before, strict=True)), shown, pair[own[d] : own[d + 1]], times[own[d] : own[d + 1]]))
            before = now
        return out


@lru_cache(maxsize=2)
def sweeper(ranks: str, model: str) -> Sweep:
    pieces = codec(ranks).pieces, piece_codec(model).pieces
    signs = [sign for i in range(max(map(len, pieces))) for sign in (b"%d," % i, b"%d|" % i, b"%d;" % i)]
    return Sweep(*(np.array([len(x) for x in p], np.int64) for p in pieces), signs)


def windows(ids: np.ndarray, lengths: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, ids) for each window in which tokens end."""
    if not len(ids):
        return
    number = (np.cumsum(lengths[ids], dtype=np.int64) - 1) // window
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
        yield int(number[s]), ids[s:e]


_EVENT = "doc_id long, file string, row long, at int, of int, side int, ids binary"


def token_ends(docs: DataFrame, side: int, path: str, window: int = WINDOW) -> DataFrame:
    """The windows of one side's token ends: at is the window, of the number of windows by size, ids 16-bit.

    A text without tokens (null, empty, not UTF-8 or with bytes that the pieces don't give back) is one row at -1.
    """
    schema, arrow = arrow_schema(_EVENT)

    def run(batches):
        c = piece_codec(path) if side else codec(path)
        lengths = np.array([len(x) for x in c.pieces], np.int64)
        for batch in batches:
            rows, size = [], 0
            for doc_id, file, row, data in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch.column(3)), strict=True):
                ids = None
                if data:
                    try:
                        spaced = " " + data.decode()
                        ids = np.frombuffer(c.encode(spaced) or b"", "<u2") if side else np.frombuffer(c._part(spaced), "<u4").astype("<u2")
                    except UnicodeDecodeError:
                        pass
                if ids is None or not len(ids):
                    rows.append((doc_id, file, row, -1, 0, side, b""))
                    continue
                of = len(data) // window + 1
                rows += [(doc_id, file, row, at, of, side, part.tobytes()) for at, part in windows(ids, lengths, window)]
                if (size := size + len(data)) > 4 << 20:
                    yield _batch(rows, arrow)
                    rows, size = [], 0
            yield _batch(rows, arrow)

    return docs.select("doc_id", "file", "row", "text").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


_ALIGNED = "doc_id long, file string, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _swept(batches, ranks: str, model: str, schema: pa.Schema):
    machine, none = sweeper(ranks, model), (0, 0, 0, 0, "", [], [])
    ready: list[tuple] = []  # documents of one window: key, ids of A, ids of B

    def flush():
        sides = [np.concatenate([r[1][i] for r in ready]) for i in (0, 1)]
        sizes = np.array([machine.lengths[0][r[1][0]].sum() for r in ready])
        found = machine.whole(sides, sizes)
        rows = [(*key, *f[:4], hashlib.sha256(f[4]).hexdigest(), f[5], f[6]) for (key, _), f in zip(ready, found, strict=True)]
        ready.clear()
        return _batch(rows, schema)

    size, key, held = 0, None, {}  # held: the ids of the window that the stream is in, by side
    bad = several = False

    def close():
        """What the document that ends here leaves: a row, or a place among the ready ones."""
        if key is None:
            return None
        if bad:
            return (*key, *none)
        empty = np.zeros(0, np.uint16)
        if several:
            machine.feed(held.get(0, empty), held.get(1, empty), True)
            return (*key, *machine.end())
        ready.append((key, (held[0], held[1])))
        return None

    at = None
    for batch in batches:
        rows = []
        for doc_id, file, row, now, of, side, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (doc_id, file, row) != key:
                rows.append(close())
                key, held, at, bad, several = (doc_id, file, row), {}, now, now < 0, of > 1
                if several:
                    machine.start()
                if size > SWEEP_BYTES and ready:
                    yield flush()
                    size = 0
            elif bad:
                continue
            if now != at:
                empty = np.zeros(0, np.uint16)
                machine.feed(held.get(0, empty), held.get(1, empty), False)
                held, at = {}, now
            held[side] = np.frombuffer(ids, "<u2")
            size += 4 * len(ids)
        yield _batch([r for r in rows if r], schema)
    if last := close():
        yield _batch([last], schema)
    if ready:
        yield flush()


def align(docs: DataFrame, ranks: str | None = None, model: str | None = None, window: int = WINDOW, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, pairs, times of every row.

    pairs has the distinct linked (A id << 16 | B id) of a document, times how often each is linked.
    Texts without tokens (null, empty, not UTF-8, or with other bytes in the pieces) have zeros and ''.
    Repeated rows are documents of their own and count as such. An empty table gives an empty one.
    Other columns are not read.

    1. Both sides' ends are encoded, shuffled by document and swept; rows are written with their distinct pairs.
    2. Documents of each pair are counted with partial sums; of a pair that is in very many documents one row comes
    from each task. 3. Counts are joined back: broadcast up to most_pairs, else shuffled, where Spark splits frequent pairs.
    """
    ranks, model = ranks or tokenizer_path("byte_bpe_50k.tiktoken"), model or tokenizer_path("piece_bpe_32k.model")
    work = Work(docs.sparkSession, "align")
    source, file, row = located(work, docs.select("doc_id", "text"))
    source = source.select("doc_id", F.col(file).alias("file"), F.col(row).alias("row"), "text")
    events = token_ends(source, 0, ranks, window).unionByName(token_ends(source, 1, model, window))
    events = events.repartition("file", "row").sortWithinPartitions("file", "row", "at", "side")
    schema, arrow = arrow_schema(_ALIGNED)
    aligned = work.table(events.mapInArrow(lambda batches: _swept(batches, ranks, model, arrow), schema), "aligned")

    counts = work.table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "counts")
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("docs").alias("most"))
    counts = counts.withColumn("a", F.shiftright("pair", 16)).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("is_best"))
    counts = work.table(counts, "ranked")
    if counts.count() <= most_pairs:
        counts = F.broadcast(counts)
    links = aligned.where("n_links > 0").select("file", "row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("file", "row", "x.pairs", "x.times")
    sums = links.join(counts, links.pairs == counts.pair).groupBy("file", "row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return aligned.join(sums, ["file", "row"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "pairs", "times")
