"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import alignment, bpe, exact_dedup, fim, katz, langid, media_ts, mixing, packing, simhash, substring, token_counts, toxicity
from sparkloom.llm.common import crc_fold, documents


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.media_features(documents(spark, sf_dir))


def op2_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(documents(spark, sf_dir)))


def op3_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("n_words").cast("long"), F.col("n_removed").cast("long"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = katz.katz_scores(documents(spark, sf_dir), crc_fold(F.col("doc_id"), 7) != 2, cutoff=1)
    return scores.select("doc_id", (crc_fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, crc_fold(F.col("doc_id"), 4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "lang_rejected")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grades = toxicity.label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.severity(docs, toxicity.fit(docs, grades, 3))


def op11_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir)).drop("pairs", "times")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(documents(spark, sf_dir))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_transport_stream, op2_sum_of_squares, op3_chunk_bpe, op4_phrase_automata, op5_trie_counts, op6_simhash, op7_katz, op8_language, op9_exact_dedup, op10_toxicity, op11_event_sweep, op12_fill_in_middle, op13_entropy_mix)
}

ORACLE: dict[str, str] = {
    "op9_exact_dedup": """
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
    """,
    "op12_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        d AS (
            SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM t),
        c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM d),
        p AS (SELECT *, '<P>' || substring(text, 1, a) AS p, '<M>' || substring(text, a + 1, b - a) AS m, '<S>' || substring(text, b + 1) AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
