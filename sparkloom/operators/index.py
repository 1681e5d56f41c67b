"""A stored inverted index: postings in runs by term, with what scores need beside each.

A posting is (term, key, field, tf, len, norm). Each task counts whole texts and writes their postings in runs that are
sorted by term, so nothing is shuffled or spilled and the pages' bounds let a query read only its terms. Text is read
once, when the index is built; it is built again if the files of its table change.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.prose import VECTOR_STOP
from sparkloom.functions.stems import stem_known, stems
from sparkloom.sources.work import Tables, files_mark, published

K1, B = 1.2, 0.75
#: Words of texts that are counted and sorted together; a longer text is a run of its own.
RUN = 1_000_000
#: Texts that come in fewer tasks for each core are dealt out before they are counted.
SPREAD = 1


@dataclass
class Index:
    postings: DataFrame
    corpus: DataFrame  # one row: n, avg_len


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build(docs: DataFrame, key: str, fields: list[str], kind: str, stemmed: bool = False) -> Index:
    """The index of some text columns; the stored one if the files are as they were.

    It is published whole and stays, so sessions may share it, and several may build it at once.
    """
    spark = docs.sparkSession

    def make(base: str) -> None:
        split = plain_words if stemmed else words
        lists = F.array(*[split(F.col(f)) for f in fields])
        kind = docs.schema[key].dataType.simpleString()
        rows = docs.select(F.col(key).alias("key"), lists.alias("words"))
        again = Tables(spark, "repeated").written(docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k")))
        if again.limit(1).count():  # rows of one key are one text
            same = F.col("key").eqNullSafe(F.col("k"))
            whole = [F.flatten(F.collect_list(F.col("words")[i])) for i in range(len(fields))]
            rows = rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").groupBy("key").agg(F.array(*whole).alias("words")))
        if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism * SPREAD:  # a file that can't be split: its texts are dealt out once
            rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
        counted = rows.mapInArrow(_counts(stemmed), f"term string, key {kind}, field int, tf int, len int, norm double")
        counted.write.option("parquet.page.row.count.limit", 2000).parquet(f"{base}/postings")
        total = spark.read.parquet(f"{base}/postings").agg(F.sum("tf").alias("total"))
        corpus = docs.agg(F.count("*").alias("n")).crossJoin(total).select("n", F.greatest(F.coalesce(F.col("total"), F.lit(0)) / F.greatest("n", F.lit(1)), F.lit(1.0)).alias("avg_len"))
        corpus.coalesce(1).write.parquet(f"{base}/corpus")

    base = published(spark, f"index-{kind}-{files_mark(spark, docs)[:32]}", make)
    return Index(spark.read.parquet(f"{base}/postings"), spark.read.parquet(f"{base}/corpus"))


def _counts(stemmed: bool):
    """Batches (key, a list of words for each field) to postings, in runs sorted by term."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in _pieces(batch):
                held.append(part)
                n += len(part.column(1).flatten().flatten())
                if n >= RUN:
                    yield from _sorted_run(held, stemmed)
                    held, n = [], 0
        if held:
            yield from _sorted_run(held, stemmed)

    return run


def _pieces(batch: pa.RecordBatch):
    """Slices of a batch that have about RUN words at most, or one row."""
    fields = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    words_ = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1).flatten()).to_numpy(zero_copy_only=False))])
    ends = words_[np.concatenate([[0], np.cumsum(fields)]).astype(np.int64)]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _sorted_run(parts: list[pa.RecordBatch], stemmed: bool):
    table = pa.Table.from_batches(parts).combine_chunks()
    lists = table.column("words").combine_chunks()
    n_fields = len(lists.flatten()) // max(1, len(lists))
    texts = pc.list_value_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)  # a row and field after the other
    coded = lists.flatten().flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return
    if stemmed:
        again = pa.array([stem_known(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
        terms, codes = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    order = pc.array_sort_indices(terms).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    slot = np.repeat(np.arange(len(texts)), texts)
    found, tf = np.unique(place[codes] * len(texts) + slot, return_counts=True)  # by term, then row and field
    term, slot = found // len(texts), found % len(texts)
    row, field = slot // n_fields, slot % n_fields
    names = terms.take(pa.array(order))
    seen = (pc.binary_length(names).to_numpy() >= 3) & ~pc.is_in(names, value_set=pa.array(list(VECTOR_STOP))).to_numpy(zero_copy_only=False)
    _, whole = np.unique(term * len(lists) + row, return_inverse=True)  # a term's count over a text's fields
    total = np.bincount(whole, weights=tf)
    squares = np.bincount(row, weights=np.where(seen[term], tf * total[whole], 0), minlength=len(lists))
    length = np.bincount(row, weights=tf, minlength=len(lists))
    keys = table.column("key").combine_chunks().take(pa.array(row))
    columns = [names.take(pa.array(term)), keys, pa.array(field.astype(np.int32)), pa.array(tf.astype(np.int32)), pa.array(length[row].astype(np.int32)), pa.array(np.sqrt(squares)[row])]
    out = pa.RecordBatch.from_arrays(columns, names=["term", "key", "field", "tf", "len", "norm"])
    yield from (out.slice(i, 100_000) for i in range(0, len(out), 100_000))


def document_frequency(docs: DataFrame, text: str, least: int = 3) -> DataFrame:
    """term, df, idf of the words of so many bytes or more, by one aggregation; no index is needed."""
    terms = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).where(F.octet_length("term") >= least)
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))  # a single row


def _counted(hits: DataFrame, word: str) -> DataFrame:
    """Adds df, in how many documents each word of the query is; a row a word is broadcast, so no word's hits meet in one task."""
    return hits.join(F.broadcast(hits.groupBy(word).agg(F.count("*").alias("df"))), word)


def hits(index: Index, query: list[str], prefixes: bool = True) -> DataFrame:
    """key, i (the query word's place), f, len, norm: how often each document has each word.

    Words of six bytes or more also count as the start of longer ones, if prefixes is set.
    """
    term = F.col("term")
    match = [term.startswith(t) if prefixes and len(t.encode()) >= 6 else term == t for t in query]
    any_ = match[0]
    for m in match[1:]:
        any_ = any_ | m
    places = F.array_compact(F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(match)]))
    rows = index.postings.where(any_).select("key", F.explode(places).alias("i"), "tf", "len", "norm")
    return rows.groupBy("key", "i").agg(F.sum("tf").alias("f"), F.first("len").alias("len"), F.first("norm").alias("norm"))


def bm25(index: Index, query: list[str]) -> DataFrame:
    """key, score of the documents that hold a query word."""
    h = hits(index, query)
    both = _counted(h, "i").crossJoin(F.broadcast(index.corpus))  # a single row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return both.groupBy("key").agg(F.sum(part).alias("score"))


def cosine_to(index: Index, query: list[str]) -> DataFrame:
    """key, cosine with a query's term vector; of short and stop words neither side has any."""
    kept = [t for t in query if len(t.encode()) >= 3 and t not in VECTOR_STOP]
    counts = {t: kept.count(t) for t in kept}
    size = sum(v * v for v in counts.values()) ** 0.5
    if not counts:
        return index.postings.select("key", F.lit(0.0).alias("cosine")).limit(0)
    h = hits(index, list(counts), prefixes=False)
    weight = F.element_at(F.array(*[F.lit(v / size) for v in counts.values()]), F.col("i") + 1)
    return h.groupBy("key").agg((F.sum(F.col("f") * weight) / F.first("norm")).alias("cosine"))


def full_text(index: Index, query: list[str], weights: list[float], every: bool = False) -> DataFrame:
    """key, score by weighted BM25 over fields, words by their stems; of any word, or of every one.

    A word's frequency in a document is the sum over fields of weight times count. Words that most documents
    have count almost nothing, but still count.
    """
    asked = index.postings.sparkSession.createDataFrame([(t,) for t in query], "w string").select(stems(F.lower("w")).alias("term")).distinct()
    terms = [r[0] for r in asked.collect()]  # the query's own words
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("field") + 1)
    h = index.postings.where(F.col("term").isin(terms)).groupBy("key", "term").agg(F.sum(F.col("tf") * weight).alias("f"), F.first("len").alias("len"))
    both = _counted(h, "term").crossJoin(F.broadcast(index.corpus))  # a single row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = both.groupBy("key").agg(F.sum(part).alias("score"), F.count("*").alias("found"))
    return (out.where(F.col("found") == len(terms)) if every else out).select("key", "score")


def hybrid(vectors: Index, texts: Index, query: list[str], weights: list[float], limit: int) -> DataFrame:
    """key, cosine, lexical_rank, score = cosine + max(0, 1 - cosine) 0.55 / (1 + rank): the best limit documents.

    Ranks are those of the best 4 limit by full text; a document without a rank has its cosine.
    """
    pool = full_text(texts, query, weights).orderBy(F.round("score", 9).desc(), "key").limit(4 * limit)
    ranked = pool.select("key", (F.row_number().over(W.orderBy(F.round("score", 9).desc(), "key")) - 1).alias("lexical_rank"))
    both = cosine_to(vectors, query).join(ranked, "key", "full")
    cos = F.coalesce("cosine", F.lit(0.0))
    score = cos + F.coalesce(F.greatest(F.lit(0.0), 1 - cos) * 0.55 / (1 + F.col("lexical_rank")), F.lit(0.0))
    out = both.select("key", F.round(cos, 6).alias("cosine"), "lexical_rank", F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), "key").limit(limit)
