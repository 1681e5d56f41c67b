"""Language identification by character language models, interpolated Kneser-Ney, one for each language.

A model is a set of sorted arrays of hashed n-grams with their interpolated probabilities and
weights. A text gets the language of lowest cross-entropy per character.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Work, arrow_schema, blocks, mix, text_bytes

ORDER = 4
#: Labelled documents of a language that a model is fitted on, about; chosen by a hash of the id among all of them.
SAMPLE_DOCS = 2_000
#: ORDER-grams of all languages that a model may have; beyond that the rarest ones are left out, see fit().
MOST_ENTRIES = 6_000_000
#: Languages that are learned: the labels of the most documents, then the first by name. The driver gets a row for each.
MOST_LANGUAGES = 4_096
#: A language with so many sampled documents leaves an eighth of them out of the counts, for its limit; one with fewer uses all.
LEAST_HELD = 40
UNDETERMINED = "und"
#: A text is rejected at its language's median cross-entropy plus this many quartile ranges, one nat by character at least.
REJECT_RANGES, REJECT_LEAST = 8.0, 1.0
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_SPACE, _DIGIT, _OTHER = 0x20, 0x30, 0x21


def has_letter(text: str) -> bool:
    """Some digits, as superscripts, aren't decimal and aren't letters either."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def _class_table() -> np.ndarray:
    """Code points of the basic plane to what the models see: lower-case letters, one digit, one sign, one space."""
    table = np.empty(0x10000, np.uint64)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace():
            table[c] = _SPACE
        elif ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
        else:
            table[c] = _DIGIT if ch.isdigit() else _OTHER
    return table


_CLASS: np.ndarray | None = None


def _far_class(c: int) -> int:
    """The class of a character beyond the basic plane: its letters share the 6,400 places of the private area, by a hash; emoji are signs."""
    ch = chr(c)
    return 0xE000 + c * 2_654_435_761 % (1 << 32) % 6_400 if ch.isalpha() else _DIGIT if ch.isdigit() else _SPACE if ch.isspace() else _OTHER


def characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of some texts as 16-bit classes, each text led by ORDER - 1 spaces; and the texts' starts."""
    global _CLASS
    if _CLASS is None:
        _CLASS = _class_table()
    pad = " " * (ORDER - 1)
    decoded = [t.decode("utf-8", "replace") for t in texts]
    code = np.frombuffer((pad + pad.join(decoded) if decoded else "").encode("utf-32-le", "surrogatepass"), np.uint32)
    big = code > 0xFFFF
    classes = _CLASS[np.where(big, 0x21, code)]
    if big.any():
        found, at = np.unique(code[big], return_inverse=True)
        classes[big] = np.array([_far_class(c) for c in found.tolist()], np.uint64)[at]
    sizes = np.array([len(d) for d in decoded], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)])[:-1]
    return classes, starts + ORDER - 1


def ngrams(classes: np.ndarray) -> np.ndarray:
    """At place i, the last ORDER characters up to i in one 64-bit key, the newest in the low 16 bits."""
    key = np.zeros(len(classes), np.uint64)
    for k in range(ORDER):
        key[k:] |= classes[: len(classes) - k] << np.uint64(16 * k)
    return key


def suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * order)) - 1) if order < 4 else keys


@dataclass
class Level:
    """n-grams of one order: sorted hashes, log-probabilities; sorted context hashes, log-weights of the lower order."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    """The first order - 1 characters of order-grams."""
    return suffix(keys, order) >> np.uint64(16)


class KneserNey:
    """Interpolated Kneser-Ney over characters, from counts of ORDER-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        levels: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):  # lower orders count how many different characters come before
            k, n = np.unique(suffix(levels[-1][0], order), return_counts=True)
            levels.append((k, n.astype(np.float64)))
        levels.reverse()
        self.levels: list[Level] = []
        alphabet = len(levels[0][0]) + 1  # one more for characters never seen
        self.uniform = -math.log(alphabet)
        for order, (k, n) in enumerate(levels, 1):
            ones, twos = float((n == 1).sum()), float((n == 2).sum())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            h = _context(k, order)
            contexts, at = np.unique(h, return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            weight = d * kinds / total
            lower = np.exp(self.logp(k, order - 1))
            p = np.maximum(n - d, 0) / total[at] + weight[at] * lower
            hg, hc = mix(k + np.uint64(order)), mix(contexts + np.uint64(order << 8))
            og, oc = np.argsort(hg), np.argsort(hc)
            self.levels.append(Level(hg[og], np.log(p[og]), hc[oc], np.log(weight[oc])))

    def logp(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each n-gram's last character after the others."""
        out = np.full(len(keys), self.uniform)
        for o in range(1, order + 1):
            level, k = self.levels[o - 1], suffix(keys, o)
            c = mix(_context(k, o) + np.uint64(o << 8))
            at = np.minimum(np.searchsorted(level.contexts, c), len(level.contexts) - 1)
            out += np.where(level.contexts[at] == c, level.weight[at], 0.0)
            g = mix(k + np.uint64(o))
            at = np.minimum(np.searchsorted(level.grams, g), len(level.grams) - 1)
            out = np.where(level.grams[at] == g, level.logp[at], out)
        return out

    def entries(self) -> int:
        return sum(len(x.grams) + len(x.contexts) for x in self.levels)


@dataclass
class LanguageModel:
    languages: list[str]
    models: list[KneserNey]
    limits: np.ndarray
    sample_docs: int


def cross_entropy(model: LanguageModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Nats by character of each text under each language, and the characters of each text."""
    classes, starts = characters(texts)
    sizes = np.diff(np.append(starts, len(classes) + ORDER - 1)) - (ORDER - 1)
    out = np.full((len(texts), len(model.models)), np.inf)
    if not len(classes):
        return out, sizes
    codes, kinds = pd.factorize(ngrams(classes))
    full = np.flatnonzero(sizes > 0)
    ends = starts[full] + sizes[full]
    for j, m in enumerate(model.models):
        # one more gap at the end: a running sum over the text alone, not over its leading spaces
        sums = np.concatenate([[0.0], np.cumsum(m.logp(kinds)[codes])])
        out[full, j] = -(sums[ends] - sums[starts[full]]) / sizes[full]
    return out, sizes


def least_count(kinds: dict[int, int], most: int) -> int:
    """The least t for which at most `most` n-grams occur t times or more; kinds: how many n-grams have each count."""
    left, t = 0, max(kinds, default=0) + 1
    for n in sorted(kinds, reverse=True):
        left += kinds[n]
        if left > most:
            break
        t = n
    return t


def fit(docs: DataFrame, train, sample_docs: int = SAMPLE_DOCS, most_entries: int = MOST_ENTRIES) -> LanguageModel:
    """Fits on about sample_docs documents for each language among the rows that train selects with a lang.

    The sample is the documents with the lowest hash of their id, in proportion: a bounded share
    of rows, so the counts that reach the driver are bounded and the model can be broadcast. If the
    sample has more than most_entries ORDER-grams, those that occur fewer than t times in their
    language are left out of the model, with the least t that fits: whole counts, the same in each
    run. No labelled row: a model without languages, which calls everything undetermined.
    """
    spark = docs.sparkSession
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.col("doc_id"), F.lit(17)).alias("h"))
    totals = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not totals:
        return LanguageModel([], [], np.zeros(0), sample_docs)
    shares = spark.createDataFrame([(r[0], min(1.0, sample_docs / r[1]), min(r[1], sample_docs) >= LEAST_HELD) for r in totals], "lang string, share double, spare boolean")
    sample = rows.join(F.broadcast(shares), "lang").where("cast(h as double) <= -pow(2.0D, 63) + share * pow(2.0D, 64)").select("lang", "text", (F.col("spare") & (F.pmod(F.shiftrightunsigned("h", 3), F.lit(8)) == 0)).alias("held"))
    schema, arrow = arrow_schema("lang string, key long, n long")

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            held = batch.column(2).to_pylist()
            texts = text_bytes(batch.column(1))
            for lang in sorted(set(langs)):
                own = [t for t, x, h in zip(texts, langs, held, strict=True) if x == lang and not h]
                for lo, hi in blocks([len(t) for t in own]):
                    classes, starts = characters(own[lo:hi])
                    real = np.ones(len(classes), bool)
                    for k in range(1, ORDER):
                        real[starts - k] = False
                    keys, n = np.unique(ngrams(classes)[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], schema=arrow)

    work = Work(spark, "langid")
    counts = work.table(sample.mapInArrow(count, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")), "counts")
    kinds = {r[0]: r[1] for r in counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()}
    table = counts.where(F.col("n") >= least_count(kinds, most_entries)).toArrow()
    langs, keys, n = table.column(0).combine_chunks().dictionary_encode(), table.column(1).to_numpy().view(np.uint64), table.column(2).to_numpy()
    work.drop("counts")
    code = langs.indices.to_numpy()
    names = sorted(langs.dictionary.to_pylist())
    models = []
    for x in names:
        own = np.flatnonzero(code == langs.dictionary.to_pylist().index(x))
        own = own[np.argsort(keys[own])]
        models.append(KneserNey(keys[own], n[own]))
    model = LanguageModel(names, models, np.full(len(names), np.inf), sample_docs)
    model.limits = calibrate(spark, sample, model)
    return model


def calibrate(spark, sample: DataFrame, model: LanguageModel) -> np.ndarray:
    """For each language, the cross-entropy above which a text is rejected.

    From the eighth of the sample that the counts left out, texts of 50 characters and more whose
    label is also the model's choice: the median plus eight quartile ranges, at least one nat
    by character over the median. A few odd or wrongly labelled documents don't move it. A language
    without such texts, as one with few documents, gets the highest limit of the others.
    """
    sent = spark.sparkContext.broadcast(model)
    schema, arrow = arrow_schema("lang string, ce double")

    def score(batches):
        for batch in batches:
            batch = batch.filter(batch.column(2))
            texts, langs = text_bytes(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in blocks([len(t) for t in texts]):
                ce, size = cross_entropy(sent.value, texts[lo:hi])
                best = ce.argmin(axis=1)
                rows = [(x, float(ce[i, best[i]])) for i, x in enumerate(langs[lo:hi]) if size[i] >= 50 and sent.value.languages[best[i]] == x]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], schema=arrow)

    quartiles = F.percentile_approx("ce", [0.25, 0.5, 0.75], 10_000)
    found = sample.mapInArrow(score, schema).groupBy("lang").agg(quartiles.alias("q")).collect()
    by = {r[0]: r[1][1] + max(REJECT_LEAST, REJECT_RANGES * (r[1][2] - r[1][0])) for r in found}
    return np.array([by.get(x, max(by.values(), default=7.0)) for x in model.languages])


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = ("lang_pred", "score", "lang_rejected")) -> DataFrame:
    """Adds lang_pred, score and lang_rejected, or what names calls them, to every row.

    lang_pred: the language of lowest cross-entropy per character (ties: the first by name), `und`
    for null texts and texts without a letter or if no language was learned. score: the share
    of that language in exp(-cross-entropy x min(characters, 50)). lang_rejected: undetermined,
    or a cross-entropy above the language's limit in a text of 20 characters or more. Only the
    text decides. Columns with these names are replaced.
    """
    docs = docs.drop(*names)
    keep = docs.schema
    schema = type(keep)([*keep.fields, *arrow_schema(", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True)))[0].fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, at = to_arrow_schema(schema), docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for blo in range(0, batch.num_rows, 1000):
                part = batch.slice(blo, 1000)
                texts = text_bytes(part.column(at))
                preds, scores, rejected = [], [], []
                for lo, hi in blocks([len(t) for t in texts]):
                    ce, size = cross_entropy(m, texts[lo:hi])
                    for i, t in enumerate(texts[lo:hi]):
                        if not m.models or not has_letter(t.decode("utf-8", "replace")):
                            preds.append(UNDETERMINED)
                            scores.append(0.0)
                            rejected.append(True)
                            continue
                        best = int(ce[i].argmin())
                        preds.append(m.languages[best])
                        scores.append(float(1 / np.exp(-(ce[i] - ce[i, best]) * min(size[i], 50)).sum()))
                        rejected.append(bool(size[i] >= 20 and ce[i, best] > m.limits[best]))
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], schema=arrow)

    return docs.mapInArrow(run, schema)
