"""Corpus preparation as a chain of stages, each written as Parquet and read again as the next one's documents.

Quality rules, language ID and near-duplicate removal drop documents; the secret scan masks what it finds; packing returns
where each piece of each document that is left lies. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringework.llm import common, langid, packing, quality, secretscan, simhash
from fringework.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a base rule broken or an improbable quality go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language, or of which less than half is in one language, go. The model learns from the
    labelled documents of three quarters of all ids."""
    model = langid.train(docs, common.crc_mod("doc_id", 4) != 2)
    return langid.keep_known(docs, model, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of its five-word shingles stays: that with the smallest id."""
    return simhash.keep_one(docs, shingle=5, share=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, those in nested encodings with the whole encoded run."""
    return secretscan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of at most 2048 tokens lies in the packed sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", best_fit_packing),
]

#: Probabilities by expectation-maximisation, Viterbi labels and XXH64 have no DuckDB form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the tables between them lie in the shared folder until the next one is written."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            common.drop_table(spark, before)
    return docs
