"""SimHash fingerprints, and their links by meet-in-the-middle ball hashing.

Two fingerprints at distance 2r or less have a common variant at distance r or less from both.
All fingerprints that emit the same variant are within 2r of each other, so one variant's
members are linked as a star, never as pairs. Variants are dealt out by their leading bits:
a fingerprint is sent once to each leading pattern within r of its own, and the task of a
pattern makes the variants that begin with it. No variant is left out; the shuffle carries
fingerprints instead of variants.

keep_one() takes near copies by Jaccard similarity. Its candidates are the links of fingerprints,
and, as fingerprints differ in some ten bits at 4/5, too many for balls, also sets that share a
band of least hashes; all candidates are compared exactly.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import jaccard
from sparkloom.llm.common import Work, arrow_schema, bloom_bits, bloom_hits, located, partitions, shared, text_bytes

BITS, LEAD, RADIUS, SEED, SHINGLE = 64, 8, 4, 42, 4


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set if it is set in over half of its shingles' hashes."""
    words = data.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(norm, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
        last = ends[shingle - 1 :] - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(norm[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)]
    array = np.array(hashes, "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(array), 65536):
        ones += np.unpackbits(array[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(array), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, f (the fingerprint as a signed long). Null and empty texts: 0."""
    schema, arrow = arrow_schema("doc_id long, f long")

    def run(batches):
        for batch in batches:
            f = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _flips(width: int, most: int) -> np.ndarray:
    """All masks of width bits with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(width), k)], np.uint64)


def _star(owner: np.ndarray, variants: np.ndarray) -> np.ndarray:
    """Pairs (smallest owner, owner) of each variant with several owners; owner, variants: 1-d, in step."""
    order = np.lexsort((owner, variants))
    v, o = variants[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.append(begin, len(v)))
    first = np.repeat(o[begin], size)
    pairs = np.stack([first, o], axis=1)[(first != o)]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (representative, member) with the same components, at most one for each member."""
    if not len(pairs):
        return pairs
    names, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(names))
    return np.stack([names[label[other]], names[other]], axis=1)


def link_pattern(f: np.ndarray, pattern: int, radius: int, lead: int = LEAD, block: int = 250_000) -> np.ndarray:
    """Linked pairs of fingerprints (unsigned) that share a variant whose leading bits are pattern.

    While a pattern has more variants than block it is split by its next bit: each variant is made
    once, and only the block at hand is in memory, however many fingerprints begin alike. Colliding
    pairs are verified by their differing bits.
    """
    low = BITS - lead
    left = radius // 2 - np.bitwise_count((f >> np.uint64(low)) ^ np.uint64(pattern)).astype(np.int64)
    found = []
    open_ = [(f[left >= 0], left[left >= 0], low)]
    while open_:
        own, left, low = open_.pop()
        total = sum(int(n) * sum(math.comb(low, k) for k in range(flips + 1)) for flips, n in enumerate(np.bincount(left)))
        if total > block and low > radius:
            bit = (own >> np.uint64(low - 1)).astype(np.int64) & 1
            for value in (0, 1):
                after = left - (bit != value)
                open_.append((own[after >= 0], after[after >= 0], low - 1))
            continue
        variants, owners = [], []
        for flips in np.unique(left).tolist():
            chosen, m = own[left == flips], _flips(low, flips)
            variants.append(((chosen[:, None] & np.uint64((1 << low) - 1)) ^ m[None, :]).ravel())
            owners.append(np.repeat(chosen, len(m)))
        pairs = _star(np.concatenate(owners), np.concatenate(variants)) if variants else np.zeros((0, 2), np.uint64)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]
        if len(pairs):
            found.append(_forest(pairs))
    return _forest(np.concatenate(found)) if found else np.zeros((0, 2), np.uint64)


def links(prints: DataFrame, radius: int = RADIUS, lead: int = LEAD) -> DataFrame:
    """a, b (longs): pairs of distinct fingerprints, at most radius apart in chains; same components as all links.

    prints has one row for each distinct f. Every fingerprint goes to the patterns of its leading
    bits within half the radius (37 of 256); a pattern's task makes and matches the variants.
    """
    masks = _flips(lead, radius // 2)
    schema, arrow = arrow_schema("pattern int, fs binary")

    def deal(batches):
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            top = (f >> np.uint64(BITS - lead))[:, None] ^ masks[None, :]
            flat, who = top.ravel().astype(np.int64), np.repeat(f, len(masks))
            order = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
            cuts = [*at.tolist(), len(flat)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][at].astype(np.int32)), pa.array([who[order][a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())], schema=arrow)

    out, out_arrow = arrow_schema("a long, b long")

    def match(key, table):
        f = np.unique(np.frombuffer(b"".join(table.column("fs").to_pylist()), np.uint64))
        pairs = link_pattern(f, key[0].as_py(), radius, lead).view(np.int64)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=out_arrow)

    return prints.select("f").mapInArrow(deal, schema).groupBy("pattern").applyInArrow(match, out).distinct()


def ball_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """links() with more leading patterns the more fingerprints there are; distinct is a written table with one row for each f."""
    lead = min(20, max(LEAD, math.ceil(math.log2(max(1, distinct.count()) / 30_000))))
    return links(distinct, radius, lead)


def components(work: Work, edges: DataFrame, most_rounds: int = 60, name: str = "cc") -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node of its component.

    Alternates linking larger neighbours and smaller neighbours to the smallest one until the
    edges stand still; each round is two aggregations and a written table.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = work.table(edges.select(low, high).where("a <> b").distinct(), f"{name}0")
    before = None
    for k in range(1, most_rounds):
        for step in ("large", "small"):
            if step == "large":
                both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            else:
                both = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            # a written table: a join with it can split the edges of a node with very many
            least = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}_least{k}{step}")
            joined = both.join(least, "a")
            if step == "large":
                new = joined.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
            else:
                new = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
            now = new.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now = work.table(now, f"{name}{k}")
        work.drop(f"{name}_least{k}large", f"{name}_least{k}small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        work.drop(f"{name}{k - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: not settled in {most_rounds} rounds")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id, n_fingerprints: every row with its class of near copies.

    component_id is the smallest doc_id reachable over links; null ids don't count, a class of
    null ids only has component_id null. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows stay; an empty table gives an empty one.
    """
    work = Work(docs.sparkSession, "simhash")
    rows = work.table(fingerprints(docs, shingle), "prints")
    least = classes(work, rows, radius)
    hex_ = F.lpad(F.lower(F.hex("f")), 16, "0")
    return rows.join(least, "f").select("doc_id", hex_.alias("fingerprint"), "component_id", "n_fingerprints")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = jaccard.SIMILARITY) -> DataFrame:
    """One row of each class of near copies, with all columns of docs: the smallest doc_id, then the first by locator.

    Near copies have sets of shingles whose Jaccard similarity is similarity or more, in chains: found by
    linked fingerprints and by bands, then compared. Texts without words are one class. Columns of any
    name pass unchanged.
    """
    work = Work(docs.sparkSession, "near")
    source, file, row = located(work, docs)
    named = source.select(F.col("doc_id").cast("long"), "text", F.col(file).alias("file"), F.col(row).alias("row"))
    rows = work.table(set_names(named, shingle), "names")
    linked = work.table(linked_sets(work, rows), "linked")
    candidates = components(work, work.table(linked.union(shared_bands(named, shingle)), "bands"), name="bands_cc")
    candidates = candidates.union(candidates.select("root", "root").distinct())  # components() leaves out the roots
    roots = components(work, work.table(similar(work, named, work.table(candidates, "candidates"), shingle, similarity), "similar"), name="similar_cc")
    rows = work.table(rows.join(work.table(roots, "roots"), rows.s == F.col("node"), "left").withColumn("root", F.coalesce("root", "s")), "rooted")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    stay = work.table(rows.groupBy("root").agg(F.min(place).alias("stay"), F.count("*").alias("n")).where("n > 1"), "stay")
    gone = rows.join(stay, "root").where((F.col("stay.file") != F.col("file")) | (F.col("stay.row") != F.col("row"))).select(F.col("file").alias(file), F.col("row").alias(row))
    gone = work.table(gone, "gone")
    work.drop("names", "prints", "linked", "bands", "candidates", "dealt", "sets", "similar", "roots", "rooted", "stay")
    return source.join(gone, [file, row], "left_anti").select(*docs.columns)


def set_names(source: DataFrame, shingle: int) -> DataFrame:
    """doc_id, s (the name of the set of shingles), f (the fingerprint), file, row."""
    schema, arrow = arrow_schema("doc_id long, s long, f long, file string, row long")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            s = np.concatenate([np.zeros(0, np.uint64), *(x[4] for x in jaccard.shingle_sets(texts, shingle))])
            f = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.view(np.int64)), pa.array(f.view(np.int64)), *batch.columns[2:]], schema=arrow)

    return source.select("doc_id", "text", "file", "row").mapInArrow(run, schema)


def linked_sets(work: Work, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (longs): names of sets whose fingerprints are equal or linked; rows has s and f.

    Each fingerprint's smallest name stands for it: links are of these, the other names hang on them as a star.
    """
    pairs = rows.select("f", "s").distinct()
    prints = work.table(pairs.groupBy("f").agg(F.min("s").alias("m")), "prints")
    equal = pairs.join(prints, "f").where("s <> m").select(F.col("m").alias("a"), F.col("s").alias("b"))
    ends = [prints.select(F.col("f").alias(x), F.col("m").alias(f"m_{x}")) for x in ("a", "b")]
    near = ball_links(prints, radius).join(ends[0], "a").join(ends[1], "b").select(F.col("m_a").alias("a"), F.col("m_b").alias("b"))
    return equal.union(near)


def shared_bands(source: DataFrame, shingle: int) -> DataFrame:
    """a, b (longs): names of sets that share a band key, linked as stars."""
    buckets = 4 * partitions(source.sparkSession)
    schema, arrow = arrow_schema("bucket int, keys binary, names binary")
    limit = 500_000  # keys that a task holds before it sends them

    def deal(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for _, _, h, first, names in jaccard.shingle_sets(text_bytes(batch.column(0)), shingle):
                keys = jaccard.band_keys(h, first)
                held.append((keys.ravel(), np.repeat(names[np.diff(first) > 0], jaccard.BANDS)))
                size += keys.size
            if size > limit:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held):
        keys, names = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        bucket = (keys % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        some = [(b, order[i:j]) for b, (i, j) in enumerate(itertools.pairwise(at)) if i < j]
        cols = [[b for b, _ in some], [keys[o].tobytes() for _, o in some], [names[o].tobytes() for _, o in some]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    out, out_arrow = arrow_schema("a long, b long")

    def match(key, table):
        keys, names = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("keys", "names"))
        pairs = _forest(_star(names, keys).reshape(-1, 2)).view(np.int64)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=out_arrow)

    return source.select("text").mapInArrow(deal, schema).groupBy("bucket").applyInArrow(match, out).distinct()


def similar(work: Work, source: DataFrame, candidates: DataFrame, shingle: int, similarity: tuple[int, int], block: int = 1000) -> DataFrame:
    """a, b (longs): names of sets that are similar, compared exactly within the components of candidates (node, root).

    A component of more sets than block is dealt out as pairs of its blocks, so that each pair of sets meets.
    """
    spark = source.sparkSession
    wanted = shared(spark, bloom_bits(candidates, "node"))
    schema, arrow = arrow_schema("s long, hashes binary")

    def run(batches):
        for batch in batches:
            for _, _, h, first, names in jaccard.shingle_sets(text_bytes(batch.column(0)), shingle):
                at = np.flatnonzero(bloom_hits(wanted.value, names) & (np.diff(first) > 0))
                yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), pa.array([h[first[i] : first[i + 1]].tobytes() for i in at.tolist()], pa.binary())], schema=arrow)

    sets = source.select("text").mapInArrow(run, schema).groupBy("s").agg(F.first("hashes").alias("hashes"))
    sizes = candidates.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    members = candidates.join(sizes, "root").withColumn("i", F.pmod(F.xxhash64("node"), "k").cast("int"))
    other = F.explode(F.when(F.col("k") == 1, F.array("i")).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("k") - 1), F.col("i")))).alias("j")
    dealt = members.select("node", "root", "i", other).select("node", "root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    dealt = work.table(dealt, "dealt").join(work.table(sets, "sets"), F.col("node") == F.col("s")).select("root", "i", "j", "s", "hashes")
    out, out_arrow = arrow_schema("a long, b long")

    def compare(table):
        names = table.column("s").to_numpy()
        found = jaccard.groups([np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()], similarity)
        pairs = names[np.array(found, np.int64).reshape(-1, 2)]
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=out_arrow)

    return dealt.groupBy("root", "i", "j").applyInArrow(compare, out)


def classes(work: Work, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """f, root, component_id, n_fingerprints for each distinct fingerprint of rows (doc_id, f), as a written table."""
    distinct = work.table(rows.groupBy("f").agg(F.min("doc_id").alias("m")), "distinct")
    roots = components(work, work.table(ball_links(distinct, radius), "links"))
    named = distinct.join(roots, distinct.f == roots.node, "left").select("f", "m", F.coalesce("root", "f").alias("root"))
    named = work.table(named, "roots")
    least = work.table(named.groupBy("root").agg(F.min("m").alias("component_id"), F.count("*").alias("n_fingerprints")), "least")
    found = work.table(named.select("f", "root").join(least, "root").select("f", "root", "component_id", "n_fingerprints"), "classes")
    work.drop("distinct", "links", "roots", "least")
    return found
