"""The corpus pipeline: each stage calls one operator of millrace.llm and hands its rows to the next.

Defined results: an empty table gives an empty result; null and empty texts weigh 0 and stay or go by the cut as others do,
link with nothing, hold no entities, take no part in the mix (they have no words) and so are not packed; rows that repeat go or stay
together in the first stage, of rows that link only those of the smallest doc_id stay, rows without doc_id never link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, ngram_join, packing, pii, quality
from millrace.llm.common import durable, forget, read
from millrace.llm.queries import public_files


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling rejects go."""
    return quality.keep_sampled(docs, read(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_in_place(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer, ranks = public_files()
    return packing.pack(docs, tokenizer=tokenizer, ranks=ranks)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", pii_surrogates),
    ("mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Hashing, sampling, keyed surrogates and packing have no SQL form; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Each one's table is deleted once the next is stored; the last but one stays, as the result reads it."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, durable(stage(spark, docs, sf_dir))
        if i:
            forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
