"""A training-data pipeline of five operators; each stage's output is the next one's ``docs``.

language ID -> near duplicates -> benchmark decontamination -> personal data -> packing

Every stage takes nulls in any column, repeated rows, columns of its own names and
tables without rows, which give tables without rows; all but the last return the
columns that they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchwell.llm import decontaminate, language_id, ngram_join, packing, pii
from patchwell.llm.scratch import crc, store


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` keeps what the table says. Null and empty texts and those without a letter go; repeated rows go or stay alike."""
    train = docs.filter(F.pmod(crc("doc_id"), F.lit(4)) != 2).select("doc_id", "text", "lang")
    return language_id.accepted(docs, language_id.fit(train))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id. Equal rows leave one; texts without words are in no group."""
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null and empty texts stay; so does all where there are no items; repeated rows stay or go alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced in their text. Null texts stay null and empty ones empty; no row goes."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. Null and empty texts are their end id alone; repeated rows are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("near_duplicates", dedup_stage), ("decontaminate", benchmark_stage), ("pii", pii_stage), ("pack", packing_stage)]

#: Models and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
