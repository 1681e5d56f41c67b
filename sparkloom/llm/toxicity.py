"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(x . w - b_k): all thresholds share the weights w, and b_0 < b_1 < ...
Features are hashed words and the starts of words, those with a weight scaled to unit length:
a start tells of a word in all its endings. Features whose score statistic can be chance have no weight, so that a few
telling words in a long text still tell.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Work, arrow_schema, text_bytes

DIMENSIONS = 1 << 18
#: Labelled documents that the model is fitted on, about, chosen by a hash of their id; all if there are fewer.
SAMPLE_DOCS = 20_000
#: Features of all documents of the sample together, which bounds the fit's memory: with more, the sample has fewer documents, each whole.
SAMPLE_FEATURES = 20_000_000
#: Bytes of a word's starts.
STARTS = (4, 5, 6, 7)
#: Least score statistic of a feature with a weight: with DIMENSIONS features, one fit in 100 has one by chance.
LEAST_Z = 5.4
#: Probability of a grade above 0 from which a text counts as toxic: below a half, as most texts aren't toxic and few of those come near.
CUT = 0.3
#: Entries of a worker's table of words; at this number the table starts again.
CACHE_WORDS = 200_000
_STRIP = b".,;:!?\"'()[]{}*#$%&|"
_KNOWN: dict[bytes, tuple[int, ...]] = {}


def _places(word: bytes) -> tuple[int, ...]:
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) >= CACHE_WORDS:
            _KNOWN.clear()
        grams = [word, *(b"^" + word[:n] for n in STARTS if n < len(word))]
        found = tuple({xxhash.xxh32_intdigest(g) & (DIMENSIONS - 1) for g in grams})
        if len(word) <= 64:
            _KNOWN[word] = found
    return found


def features(data: bytes) -> np.ndarray:
    """Places of a text's distinct words, lower-cased (A-Z) and without outer signs, and of their starts.

    A start of three or more distinct words has a second place.
    """
    words = {x.strip(_STRIP) for x in data.lower().split()}
    words.discard(b"")
    places, counts = np.unique(np.fromiter(chain.from_iterable(map(_places, words)), np.int64), return_counts=True)
    return np.union1d(places, (places[counts >= 3] * 0x9E3779B1 + 0x85EBCA6B) & (DIMENSIONS - 1))


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray

    def margin(self, f: np.ndarray) -> float:
        """x . w of a text's features, for x of unit length over the features that have a weight."""
        w = self.weights[f]
        return w.sum() / max(1, np.count_nonzero(w)) ** 0.5

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) of each text for each threshold k."""
        found = [features(t) for t in texts]
        margin = np.array([self.margin(f) for f in found])
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.cuts[None, :], -40, 40)))


def fit_ordinal(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 400, l2: float = 0.1, rate: float = 0.1) -> Ordinal:
    """Maximum likelihood with a ridge, by full-batch Adam; deterministic.

    flat has the features of all rows one after the other, sizes the number of each row. Only
    features whose score statistic in the model without features is LEAST_Z or more have a
    weight. A grade without rows keeps its threshold above the one before.
    """
    n, k = len(sizes), n_grades - 1
    weights, b = np.zeros(DIMENSIONS), np.zeros(k)
    for j in range(k):
        share = np.clip((grades > j).mean() if n else 0.5, 1e-6, 1 - 1e-6)
        b[j] = -np.log(share / (1 - share))
    b = np.maximum.accumulate(b + 1e-3 * np.arange(k))
    if not n:
        return Ordinal(weights, b)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def slopes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood's slopes by each row's margin and by each threshold."""
        # P(grade = g) = s(m - b[g-1]) - s(m - b[g]), with s = 1 before the first and 0 after the last threshold
        s = np.concatenate([np.ones((n, 1)), sigmoid(m[:, None] - b[None, :]), np.zeros((n, 1))], axis=1)
        hi, lo = s[np.arange(n), grades], s[np.arange(n), grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        db = np.zeros(k)
        np.add.at(db, np.maximum(grades - 1, 0), np.where(grades > 0, -dhi, 0))
        np.add.at(db, np.minimum(grades, k - 1), np.where(grades < k, dlo, 0))
        return dhi - dlo, db

    who = np.repeat(np.arange(n, dtype=np.int32), sizes)
    start = slopes(np.zeros(n))[0]
    start -= start.mean()
    df = np.bincount(flat, minlength=DIMENSIONS)
    spread = start.var() * df * (1 - df / n)
    z = np.bincount(flat, start[who], minlength=DIMENSIONS) / np.sqrt(np.maximum(spread, 1e-12))
    kept = np.flatnonzero((np.abs(z) >= LEAST_Z) & (spread > 0) & (df >= 5))
    place = np.full(DIMENSIONS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    f = place[flat]
    who, f = who[f >= 0], f[f >= 0]
    x = np.maximum(np.bincount(who, minlength=n), 1) ** -0.5
    w, mw, vw, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(k), np.zeros(k)
    for t in range(1, epochs + 1):
        dm, db = slopes(np.bincount(who, w[f], minlength=n) * x)
        grad = np.bincount(f, (dm * x)[who], minlength=len(kept)) - l2 * w
        mw, mb = 0.9 * mw + 0.1 * grad, 0.9 * mb + 0.1 * db
        vw, vb = 0.99 * vw + 0.01 * grad**2, 0.99 * vb + 0.01 * db**2
        step = rate * (1 - t / (epochs + 1)) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w += step * mw / (np.sqrt(vw) + 1e-8)
        b = np.maximum.accumulate(b + step * mb / (np.sqrt(vb) + 1e-8) + 1e-6 * np.arange(k))
    weights[kept] = np.where(w == 0, 1e-12, w)  # what has a weight counts towards the length
    return Ordinal(weights, b)


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, sample_docs: int = SAMPLE_DOCS, sample_features: int = SAMPLE_FEATURES) -> Ordinal:
    """Fits on a bounded sample of the documents that have a grade (doc_id, grade; nulls don't count).

    The sample is the documents of lowest hash of their id, about sample_docs, and fewer if they
    have more than sample_features features together; each with all its features, as when scored.
    grades must have one row for each doc_id; n_grades is 2 or more. Without a graded document
    the weights are zero.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").join(grades.where("grade is not null and doc_id is not null"), "doc_id")
    n = rows.select("doc_id").count()
    share = min(1.0, sample_docs / max(n, 1))
    rank = F.xxhash64("doc_id", F.lit(5))
    chosen = rows.select("doc_id", "text", F.col("grade").cast("int").alias("grade"), rank.alias("rank")).where(F.col("rank").cast("double") <= -(2.0**63) + share * 2.0**64)
    schema, arrow = arrow_schema("doc_id long, grade int, rank long, f binary")

    def run(batches):
        for batch in batches:
            fs = [features(t).astype("<i4").tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(fs, pa.binary())], schema=arrow)

    work = Work(docs.sparkSession, "toxicity")
    made = work.table(chosen.mapInArrow(run, schema), "features")
    # about sample_docs short rows: the largest rank at which all features up to it fit
    sizes = made.select("rank", F.octet_length("f").alias("b")).toArrow().sort_by("rank")
    fits = np.cumsum(sizes.column("b").to_numpy(), dtype=np.int64) <= 4 * sample_features
    if not fits.all():
        made = made.where(F.col("rank") < int(sizes.column("rank")[int(fits.argmin())].as_py()))
    table = made.drop("rank").toArrow().sort_by([("doc_id", "ascending"), ("f", "ascending")])
    work.drop("features")
    found, grade = table.column("f"), table.column("grade").to_numpy().astype(np.int64)
    lengths = pc.binary_length(found).to_numpy().astype(np.int64) // 4
    flat = np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(f.as_py(), "<i4") for f in found)])
    return fit_ordinal(flat, lengths, grade, n_grades)


def severity(docs: DataFrame, model: Ordinal, cut: float = CUT) -> DataFrame:
    """doc_id, expected_severity, p_above (one for each threshold), grade, toxic of every row.

    expected_severity is the sum of P(grade > k); grade the most probable one (ties: the lower);
    toxic is P(grade > 0) of cut or more. Null and empty texts have no features: what the
    thresholds alone say. Repeated rows get equal values.
    """
    schema, arrow = arrow_schema("doc_id long, expected_severity double, p_above array<double>, grade int, toxic boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                texts = text_bytes(batch.column(1).slice(lo, 1000))
                p = sent.value.above(texts)
                each = np.concatenate([np.ones((len(p), 1)), p], axis=1) - np.concatenate([p, np.zeros((len(p), 1))], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1000), pa.array(p.sum(axis=1)), pa.array(list(p), pa.list_(pa.float64())), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= cut)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def label_grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 not toxic, 1 toxic, 2 toxic in a text of low quality; several rows of an id: the highest."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    return labels.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.max("grade").alias("grade"))
