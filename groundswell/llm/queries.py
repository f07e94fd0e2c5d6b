"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, language_id, mixing, near_dedup, packing, pii, quality, substring_dedup, suffix_tree_lm
from .common import documents


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(documents(spark, sf_dir), word_vocabulary())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_near_duplicates(documents(spark, sf_dir), words=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = language_id.learn(docs.where(language_id.fold() != 1))
    return language_id.predict(docs, profiles).select("doc_id", (language_id.fold() == 1).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_quality": op2_quality, "op3_near_dedup": op3_near_dedup, "op4_suffix_dedup": op4_suffix_dedup, "op5_fingerprints": op5_fingerprints, "op6_mixing": op6_mixing, "op7_lm_scoring": op7_lm_scoring, "op8_pii": op8_pii, "op9_exact_dedup": op9_exact_dedup, "op10_language_id": op10_language_id, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": near_dedup.oracle(), "op9_exact_dedup": exact_dedup.ORACLE}
