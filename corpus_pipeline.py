"""From documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. Documents that
are clean and unlike any other pass unchanged until they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, langid, packing, simhash, substring
from sparkloom.llm.common import Work, small_batches, unused

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or unlike every language. lang stays as it was."""
    small_batches(spark)
    model = langid.fit(docs, F.lit(True))
    names = unused(["lang_pred", "score", "lang_rejected"], docs.columns)
    return langid.identify(docs, model, tuple(names)).where(~F.col(names[2])).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one stays."""
    small_batches(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (0.8 or more of their shingles are common, in chains), the smallest doc_id stays.

    Links of fingerprints, as op 6 makes them, and bands of least hashes give candidates; these are compared exactly.
    """
    small_batches(spark)
    return simhash.keep_one(docs, SHINGLE)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document has; documents of nothing else go.

    A document that loses nothing keeps its text as it was.
    """
    small_batches(spark)
    words, removed, kept, _ = names = unused(list(substring.NAMES), docs.columns)
    found = substring.remove_repeats(docs, names=tuple(names))
    loses = F.col(removed) > 0
    found = found.where(~loses | (F.col(removed) < F.col(words))).withColumn("text", F.when(loses, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(loses, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences of 2,048."""
    small_batches(spark)
    return packing.pack(packing.token_pieces(docs))


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("packed", packed)]
#: Language models, fingerprints and byte-pair ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
        if before:  # what the last stage took is written anew
            work.drop(before)
        before = name
    return docs
