"""Removal of passages that an earlier document has: sharded phrase automata.

A window is WINDOW consecutive words. Of the phrases of PHRASE words in a window, the one of
smallest hash is its anchor; equal windows have equal anchors, so windows are compared anchor
by anchor. 1. Anchors that several documents have are found. 2. The stretches of words whose
windows have such an anchor are written; windows that occur in several documents are
confirmed, and the stretches of the smallest document of each are the confirmed passages. 3. The
passages' phrases are compiled to Aho-Corasick automata, one for each shard, and the stretches of
the shard's anchors are streamed through to locate every occurrence; the windows around one
are looked up among the passages' windows and compared with them word by word. 4. Every document
loses the words of windows that an earlier document has.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD_BLOCK_BYTES, Work, Words, arrow_schema, blocks, bloom_bits, bloom_hits, bloom_size, partitions, range_hashes, shared, utf8_bytes, unused

WINDOW, PHRASE = 50, 25
_H1, _H2, _G = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: An anchor of more stretches than one part in so many, or than HOT_ROWS, whichever is more, is dealt to several tasks.
HOT_PARTS, HOT_ROWS = 1_000, 1_000
#: Stretches of a shard, about; passages of one anchor in a shard, beyond which its windows are dealt one by one, in so many parts.
SHARD_ROWS, MOST_PASSAGES, WINDOW_PARTS = 5_000, 1_000, 16


def window_hashes(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return range_hashes(h, at, at + window, _H1), range_hashes(h, at, at + window, _H2)


def anchors(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, its word, the first and the last window (as words)."""
    n = len(words.doc)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none, none, none
    at = np.arange(n - phrase + 1)
    g = range_hashes(words.hashes(), at, at + phrase, _G)
    k = window - phrase + 1
    place = np.empty(n - window + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, k)
    for lo in range(0, len(view), 1 << 15):
        place[lo : lo + (1 << 15)] = view[lo : lo + (1 << 15)].argmin(axis=1)
    place += np.arange(len(place))
    real = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
    place = place[real]
    if not len(place):
        return none.astype(np.uint64), none, none, none
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(begin[1:], len(place)) - 1
    return g[place[begin]], place[begin], real[begin], real[last]


def _row_key(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _batch(rows, arrow):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def repeated_spans(work: Work, docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """doc_id, key, spans: for every text with windows that a smaller doc_id has, their word ranges.

    key is the text's hash. Rows without an id neither lose words nor count as earlier.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")

    a_schema, a_arrow = arrow_schema("a long, lo long, hi long")

    def find(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), utf8_bytes(batch.column(1))
            found = []
            for lo, hi in blocks([len(t) for t in texts], WORD_BLOCK_BYTES):
                words = Words(texts[lo:hi])
                a, place, _, _ = anchors(words, window, phrase)
                found.append((a.view(np.int64), ids[lo:hi][words.doc[place]]))
            a, doc = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            order = np.lexsort((doc, a))
            a, doc = a[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(a))[: len(first)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(doc[first]), pa.array(doc[last])], schema=a_arrow)

    common = rows.mapInArrow(find, a_schema).groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("a")
    common = work.table(common, "anchors")
    n_common = common.count()
    bits = bloom_size(n_common)
    filter_ = shared(spark, bloom_bits(common, "a", bits))

    s_schema, s_arrow = arrow_schema("a long, doc_id long, key long, at int, skip int, words binary")

    def stretch(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8_bytes(batch.column(1))
            for lo, hi in blocks([len(t) for t in texts], WORD_BLOCK_BYTES):
                words = Words(texts[lo:hi])
                a, place, begin, end = anchors(words, window, phrase)
                hit = np.flatnonzero(bloom_hits(filter_.value, a))
                doc = words.doc[place[hit]]
                keys = {d: np.uint64(_row_key(texts[lo + d])).astype(np.int64) for d in np.unique(doc).tolist()}
                out = [
                    (int(x), ids[lo + d], keys[d], b - int(words.first[d]), p - b, words.text(b, e + window))
                    for x, d, p, b, e in zip(a[hit].view(np.int64).tolist(), doc.tolist(), place[hit].tolist(), begin[hit].tolist(), end[hit].tolist(), strict=True)
                ]
                yield _batch(out, s_arrow)

    stretches = rows.mapInArrow(stretch, s_schema)
    if n_common > bits // 10:  # the filter is at its largest and lets much pass: leave that to a join
        stretches = stretches.join(common, "a", "left_semi")
    stretches = work.table(stretches, "stretches")
    work.drop("anchors")

    w_schema, w_arrow = arrow_schema("w1 long, w2 long, a long, doc_id long")

    def windows(batches):
        for batch in batches:
            a, ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for lo, hi in blocks([len(t) for t in texts], WORD_BLOCK_BYTES):
                words = Words(texts[lo:hi])
                n = len(words.doc) - window + 1
                at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
                w1, w2 = window_hashes(words.hashes(), at, window)
                who = words.doc[at] + lo
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(a[who]), pa.array(ids[who])], schema=w_arrow)

    seen = stretches.select("a", "doc_id", "words").mapInArrow(windows, w_schema).groupBy("w1", "w2", "a").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = work.table(seen.where("first < last").select("a", "first").distinct(), "firsts")

    # an anchor with a large share of all stretches goes to several tasks; there are at most HOT_PARTS such
    passages = firsts.groupBy("a").agg(F.count("*").alias("k"))
    passages = passages.where(F.col("k") > most_passages).select("a", F.lit(None).cast("array<long>").alias("firsts")).union(
        firsts.join(passages.where(F.col("k") <= most_passages), "a").groupBy("a").agg(F.collect_list("first").alias("firsts"))
    )
    per_anchor = work.table(stretches.groupBy("a").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo")).join(passages, "a"), "phrases")
    work.drop("firsts")
    total = per_anchor.agg(F.sum("n")).first()[0] or 0
    share, shards = max(HOT_ROWS, total // HOT_PARTS), max(4 * partitions(spark), -(-total // SHARD_ROWS))
    per_anchor = per_anchor.withColumn("salts", F.ceil(F.col("n") / share).cast("int"))
    # at most HOT_PARTS anchors, of at most most_passages ids each: they join where the stretches lie
    hot = F.broadcast(per_anchor.where("salts > 1"))
    found = stretches.join(hot, "a").unionByName(stretches.join(hot, "a", "left_anti").join(per_anchor.where("salts = 1"), "a"))

    def dealt(df, kind):
        salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)) if kind == 1 else F.pmod(F.xxhash64("doc_id", "key"), F.col("salts")).cast("int")
        df = df.withColumn("salt", salt)
        return df.select(F.pmod(F.xxhash64("a", "salt"), F.lit(shards)).cast("int").alias("shard"), F.lit(kind).alias("kind"), "a", "doc_id", "key", "at", (F.col("skip") if kind == 1 else F.lit(None).cast("int")).alias("skip"), "words")

    few, many = found.where("firsts is not null"), found.where("firsts is null")
    nowhere = {"key": F.lit(0).cast("long"), "at": F.lit(0)}
    # a passage that its documents hold many times is one passage, of the smallest of them
    once = few.where(F.array_contains("firsts", F.col("doc_id"))).groupBy("a", "skip", "words", "salts").agg(F.min("doc_id").alias("doc_id")).withColumns(nowhere)
    # an anchor's smallest document has no earlier one and loses nothing by it
    inputs = dealt(once, 1).union(dealt(few.where("doc_id > lo"), 2))
    if per_anchor.where("firsts is null").limit(1).count():
        # an anchor with very many passages: its windows one by one, each with its smallest document
        single = work.table(many.select(*s_schema.names).mapInArrow(lambda batches: one_by_one(batches, window), s_schema), "single").withColumn("salts", F.lit(WINDOW_PARTS))
        least = single.groupBy("a", "skip", "words", "salts").agg(F.min("doc_id").alias("doc_id")).withColumns(nowhere)
        inputs = inputs.union(dealt(least, 1)).union(dealt(single, 2))
    inputs = inputs.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "a")

    o_schema, o_arrow = arrow_schema("doc_id long, key long, start int, end int")

    def locate(batches):
        shard, held, passages = None, [], None
        for batch in batches:
            where, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 0) | (np.diff(kinds) != 0)])) if batch.num_rows else []
            for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(int(i), int(j - i))
                if where[i] != shard:
                    shard, held, passages = where[i], [], None
                col = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                if kinds[i] == 1:
                    held.append((col["doc_id"].to_numpy(), col["skip"].to_numpy(), col["words"].to_pylist()))
                    continue
                if passages is None:
                    passages, held = Passages(held, window, phrase), []
                yield from _located(col, passages)

    def _located(col, passages):
        ids, keys, ats, texts = col["doc_id"].to_numpy(), col["key"].to_numpy(), col["at"].to_numpy(), col["words"].to_pylist()
        for lo, hi in blocks([len(t) for t in texts], WORD_BLOCK_BYTES):
            words = Words(texts[lo:hi])
            begin = passages.phrases(words)
            # windows around a located phrase: those that start up to window - phrase words before it
            at = np.unique((begin[:, None] - np.arange(window - phrase + 1)[None, :]).ravel())
            at = at[(at >= 0) & (at + window <= len(words.doc))]
            at = at[words.doc[at] == words.doc[at + window - 1]]
            at = at[passages.earlier(words, at, ids[words.doc[at] + lo])]
            who = words.doc[at] + lo
            if not len(at):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(who) != 0)]))
            end = np.append(cut[1:], len(at)) - 1
            shift = ats[who[cut]] - words.first[who[cut] - lo]
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[cut]]), pa.array(keys[who[cut]]), pa.array((at[cut] + shift).astype(np.int32)), pa.array((at[end] + window + shift).astype(np.int32))], schema=o_arrow)

    spans = inputs.mapInArrow(locate, o_schema)
    spans = work.table(spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    work.drop("stretches", "phrases", "single")
    return spans


def one_by_one(batches, window: int):
    """Stretches cut to their windows: each window is a stretch, and its hash its anchor."""
    for batch in batches:
        ids, keys, ats, skips, texts = (batch.column(i).to_pylist() for i in range(1, 6))
        for lo, hi in blocks([len(t) for t in texts], WORD_BLOCK_BYTES):
            words = Words(texts[lo:hi])
            n = len(words.doc) - window + 1
            at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
            w1, _ = window_hashes(words.hashes(), at, window)
            out = []
            for a, i, who in zip(w1.view(np.int64).tolist(), at.tolist(), (words.doc[at] + lo).tolist(), strict=True):
                place = i - int(words.first[who - lo])
                out.append((a, ids[who], keys[who], ats[who] + place, skips[who] - place, words.text(i, i + window)))
            yield _batch(out, batch.schema)


class Passages:
    """The confirmed passages of a shard: an automaton of their phrases, and their windows with the smallest document of each."""

    def __init__(self, held: list, window: int, phrase: int) -> None:
        ids, skips = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in held)]).astype(np.int64) for i in (0, 1))
        texts = [t for h in held for t in h[2]]
        self.window, self.phrase = window, phrase
        self.words = words = Words(texts)
        self.machine = ahocorasick.Automaton()
        for i, skip in enumerate(skips.tolist()):
            begin = int(words.first[i]) + skip
            self.machine.add_word(f" {words.text(begin, begin + phrase).decode('latin-1')} ", 1)
        self.machine.make_automaton()
        n = len(words.doc) - window + 1
        at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        w1, w2 = (x.view(np.int64) for x in window_hashes(words.hashes(), at, window))
        owner = ids[words.doc[at]]
        order = np.lexsort((owner, w2, w1))
        w1, w2, owner, at = w1[order], w2[order], owner[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        self.lookup = w1[new], w2[new], np.flatnonzero(new)
        self.owner, self.at = owner, at

    def phrases(self, words: Words) -> np.ndarray:
        """The words at which an occurrence of a phrase begins."""
        if not len(self.machine):
            return np.zeros(0, np.int64)
        ends = np.array([e for e, _ in self.machine.iter(f" {words.data.decode('latin-1')} ")], np.int64) - 1
        last = np.searchsorted(words.ends, ends)
        begin = last - self.phrase + 1
        return begin[(begin >= 0) & (words.doc[np.maximum(begin, 0)] == words.doc[last])]

    def earlier(self, words: Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """True for the windows at `at` of documents ids that a smaller document's passage has, word by word."""
        w1, w2 = (x.view(np.int64) for x in window_hashes(words.hashes(), at, self.window))
        found = _look_up(self.lookup, w1, w2)
        out = found >= 0
        out[out] = self.owner[found[out]] < ids[out]
        chosen = np.flatnonzero(out)
        if not len(chosen):
            return out
        here, there = at[chosen], self.at[found[chosen]]
        # windows that follow each other in both are compared at once
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(here) != 1) | (np.diff(there) != 1)]))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(chosen)], strict=True):
            if words.text(here[i], here[j - 1] + self.window) != self.words.text(there[i], there[j - 1] + self.window):
                for k in range(i, j):  # hashes agree and words don't
                    out[chosen[k]] = words.text(here[k], here[k] + self.window) == self.words.text(there[k], there[k] + self.window)
        return out


def _look_up(lookup, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """The value of each window; -1 where it isn't there. Equal first halves are walked through."""
    p1, p2, value = lookup
    out = np.full(len(w1), -1)
    at = np.searchsorted(p1, w1)
    open_ = np.arange(len(w1))
    while len(open_):
        inside = at[open_] < len(p1)
        open_ = open_[inside]
        open_ = open_[p1[at[open_]] == w1[open_]]
        same = p2[at[open_]] == w2[open_]
        out[open_[same]] = value[at[open_[same]]]
        at[open_] += 1
        open_ = open_[~same]
    return out


NAMES = ("n_words", "n_removed", "kept_text", "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, names: tuple[str, str, str, str] = NAMES, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """Adds n_words, n_removed, kept_text and spans, or what names calls them, to every row.

    Words are runs of characters other than [\\x20\\x09-\\x0D]. A word goes if a window of the
    row's words that covers it also starts in a document with a smaller doc_id; windows are judged
    on the input. kept_text has the other words with one space between. Null texts have no words;
    rows without an id lose none; rows that share an id don't count for each other. Windows
    that repeat within one document stay. Columns with a name of names are replaced; all others pass unchanged.
    """
    spark = docs.sparkSession
    work = Work(spark, "substring")
    docs = docs.drop(*names)
    spans = repeated_spans(work, docs, window, phrase, most_passages)
    filter_ = shared(spark, bloom_bits(spans, "key", bloom_size(spans.count())))
    base = docs.schema
    doc_, key_, spans_ = unused(["_doc", "_key", "_spans"], docs.columns)
    keyed, _ = arrow_schema(f"{key_} long")
    from pyspark.sql.pandas.types import to_arrow_schema

    with_key = type(base)([*base.fields, *keyed.fields])
    full = type(base)([*base.fields, *arrow_schema(", ".join(f"`{n}` {t}" for n, t in zip(names, ("int", "int", "string", "array<struct<start:int,end:int>>"), strict=True)))[0].fields])
    full_arrow, key_arrow, at = to_arrow_schema(full), to_arrow_schema(with_key), docs.columns.index("text")

    def rows(hits: bool, joined: bool):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    texts = utf8_bytes(part.column(at))
                    if not joined:
                        keys = np.array([_row_key(t) for t in texts], np.uint64)
                        mask = bloom_hits(filter_.value, keys) == hits
                        part, texts, keys = part.filter(pa.array(mask)), [t for t, m in zip(texts, mask, strict=True) if m], keys[mask]
                        if hits:
                            yield pa.RecordBatch.from_arrays([*(part.column(i).cast(f.type) for i, f in enumerate(list(key_arrow)[:-1])), pa.array(keys.view(np.int64))], schema=key_arrow)
                            continue
                    found = part.column(len(base)).to_pylist() if joined else [None] * len(texts)
                    out = [[], [], [], []]
                    for t, sp in zip(texts, found, strict=True):
                        words = t.split()
                        kept, start = [], 0
                        for s in sp or ():
                            if s["start"] > start:
                                kept += words[start : s["start"]]
                            start = max(start, s["end"])
                        kept += words[start:]
                        for c, v in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8"), sp or []), strict=True):
                            c.append(v)
                    yield pa.RecordBatch.from_arrays([*(part.column(i).cast(full_arrow.field(i).type) for i in range(len(base))), *(pa.array(v, full_arrow.field(len(base) + i).type) for i, v in enumerate(out))], schema=full_arrow)

        return run

    alone = docs.mapInArrow(rows(False, False), full)
    named = spans.select(F.col("doc_id").alias(doc_), F.col("key").alias(key_), F.col("spans").alias(spans_))
    some = docs.mapInArrow(rows(True, False), with_key)
    some = some.join(named, (some[key_] == named[key_]) & (some["doc_id"] == named[doc_]), "left").select(*[some[c] for c in docs.columns], named[spans_])
    return alone.unionByName(some.mapInArrow(rows(True, True), full))
