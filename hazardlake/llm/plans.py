"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.llm import chat, language, minhash, mixing, passages, postings, quality, runs, surrogates, tokens, toxicity, turns, twins, vectors
from hazardlake.session import use_package, work_dir

#: Key of the registered surrogate query; a real corpus needs a secret one.
KEY = b"public test key"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_table(spark, sf, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))


def op2_preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return chat.preference_segments(chat.other_answers(_table(spark, sf, "conversations")))


def token_digest(docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs``, read them back and digest each document's ids."""
    spark = docs.sparkSession
    path = work_dir(spark, "tokens")
    tokens.write_tokens(docs, path, tokenizer_path())
    return tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_patched_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_digest(_table(spark, sf, "documents"))


def op4_scheduled_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(_table(spark, sf, "documents"))


def op5_subsequence_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf, "documents"), _table(spark, sf, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op6_minmax_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return (minhash.near_duplicates(_table(spark, sf, "documents"))
            .withColumnRenamed("id", "doc_id").select("doc_id", "n_shingles", "component_id", "kept"))


def op7_positional_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = postings.decontaminate(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_rotation_code_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf, "embeddings"))


def op9_surrogate_pii(spark: SparkSession, sf: str) -> DataFrame:
    return surrogates.replace_personal(_table(spark, sf, "documents"), KEY)


def op10_count_min_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.planted(_table(spark, sf, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turns.conversations_report(_table(spark, sf, "conversations"))


def op13_distribution_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return quality.filter_quality(_table(spark, sf, "documents")).drop("class_distance", "word_distance")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    use_package(spark)
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_mixture, op2_preference_pairs, op3_patched_token_files, op4_scheduled_mix, op5_subsequence_toxicity,
        op6_minmax_near_dedup, op7_positional_decontamination, op8_rotation_code_dedup, op9_surrogate_pii,
        op10_count_min_passages, op11_periodic_runs, op12_conversation_repair,
        op13_distribution_divergence, pipeline)}
SQL: dict[str, str] = {
    "op2_preference_pairs": chat.SQL,
    "op6_minmax_near_dedup": twins.NEAR_DUPLICATES,
    "op7_positional_decontamination": twins.DECONTAMINATION,
    "op8_rotation_code_dedup": twins.NEAR_VECTORS,
    "op10_count_min_passages": twins.PASSAGES,
    "op11_periodic_runs": twins.PERIODIC_RUNS,
    "op12_conversation_repair": twins.CONVERSATIONS,
    "op13_distribution_divergence": twins.QUALITY,
}
