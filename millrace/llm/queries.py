"""The queries of this folder: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, matroska, mixing, ngram_join, packing, pii, preference, quality, substring, toxicity
from .common import read


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"))


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def public_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, ranks = public_files()
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer=tokenizer, ranks=ranks)


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_sorted_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.texts_as_media(read(spark, sf_dir, "documents"))


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_table(read(spark, sf_dir, "conversations"))


def op8_sliding_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_weighted_fair_mix": op2_weighted_fair_mix,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_sorted_projection_passes": op5_sorted_projection_passes,
    "op6_matroska": op6_matroska,
    "op7_preference_formatting": op7_preference_formatting,
    "op8_sliding_sentence_spans": op8_sliding_sentence_spans,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {}
